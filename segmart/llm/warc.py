"""Web archives: writing with revisit records, and reading by verified chains of record offsets."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmart.llm.common import columns_as, materialise, named
from segmart.session import new_path

# Fixed values of the format.
MAGIC = "WARC/1.1\r\n"
_END = "\r\n\r\n"
_REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEX_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: eight groups of 20 bits, four digits each."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _HEX_DIGITS, _BASE32)


def _record_id(page: Column, order: Column) -> Column:
    """A URN with the page's number in its last 64 bits; a page without one gets its place among the rows."""
    digits = F.lower(F.lpad(F.hex(F.coalesce(page.cast("long"), order)), 16, "0"))
    first = F.when(page.isNull(), "00000001").otherwise("00000000")
    return F.concat(
        F.lit("urn:uuid:"), first, F.lit("-0000-0000-"), F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 12)
    )


def _page_of(urn: Column) -> Column:
    """The page number in a record id, null if it was written for a page without one."""
    digits = F.replace(F.right(urn, F.lit(17)), F.lit("-"), F.lit(""))
    return F.when(F.substring(urn, 10, 8) == "00000000", F.conv(digits, 16, -10).cast("long"))


def page_records(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html"
) -> DataFrame:
    """page_id, record: the text of one record per row of ``pages``, without its final blank lines.

    Of equal payloads the row with the smallest id is the response, the others revisit it. A null
    payload is empty; rows that share the smallest id are all responses; rows without id come after
    those with one, and are all responses if no row of their payload has one. Characters of a URL that
    would break a header line are escaped.
    """
    payload = F.coalesce(named(payload_column).cast("string"), F.lit(""))
    rows = pages.select(
        named(id_column).cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce(named(url_column).cast("string"), F.lit("")), r"[\x00-\x20\x7f]", "%20").alias("url"),
        payload.alias("payload"),
    ).withColumn("digest", base32_sha1(F.col("payload")))
    # Digest and length as well as a second hash: different payloads are not taken for one another.
    rows = rows.withColumn("content", F.concat_ws(":", "digest", F.octet_length("payload"), F.xxhash64("payload")))
    # Narrow partial minima; the adaptive join spreads a payload that very many pages share.
    first = rows.groupBy("content").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = materialise(first.where("n > 1").select("content", "first_id"), "warc-repeated")
    joined = rows.join(repeated, "content", "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("first_id").isNotNull(), F.lit(False))
    order = F.xxhash64("url", "content")
    size = F.octet_length("payload").cast("string")
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(_END)
    )
    block = F.when(revisit, http).otherwise(F.concat(http, "payload"))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    return joined.select(
        "page_id",
        F.concat(
            F.lit(MAGIC),
            header("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            header("WARC-Record-ID", F.concat(F.lit("<"), _record_id(F.col("page_id"), order), F.lit(">"))),
            header("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
            header("WARC-Target-URI", F.col("url")),
            header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(
                revisit,
                F.concat(
                    header("WARC-Refers-To", F.concat(F.lit("<"), _record_id(F.col("first_id"), order), F.lit(">"))),
                    header("WARC-Profile", F.lit(_REVISIT_PROFILE)),
                ),
            ).otherwise(""),
            header("Content-Type", F.lit("application/http; msgtype=response")),
            header("Content-Length", F.octet_length(block).cast("string")),
            F.lit("\r\n"),
            block,
        ).alias("record"),
    )


def write_archives(records: DataFrame, path: str, compression: str = "none") -> None:
    """Archive files below ``path``, one for each partition, each compressed as a whole if asked for.

    A record ends with two blank lines, so records are the lines of a text file with that separator;
    Spark's committer keeps the files whole when tasks are run again.
    """
    writer = records.select("record").write.mode("errorifexists").option("lineSep", _END)
    writer.option("compression", compression).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, n, piece: what follows each magic up to the next one.

    Files are split like any text, with the magic as the separator; compressed ones are one block. The
    splits follow from the files and the session, so ``n`` is the same whenever they are read.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("n"),
        F.col("value").alias("piece"),
    )


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place where the magic occurs: file, block, n, at, succ.

    ``at`` is the offset of the magic, ``succ`` the offset after the record that a header there would
    begin, null if none can be read. Occurrences inside payloads are candidates too.
    """
    head = F.substring_index("piece", _END, 1)
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length: *([0-9]{1,18}) *(?:\r\n|$)", 1)
    span = F.when(
        F.contains("piece", F.lit(_END)) & (length != ""), F.octet_length(head) + 4 + length.try_cast("long") + 4
    )
    lines = materialise(
        _pieces(spark, path).select(
            "file", "block", "n", F.octet_length("piece").cast("long").alias("size"), span.alias("span")
        ),
        "warc-lines",
    )
    # Offsets: sums inside a block, which a split bounds, on top of sums over the blocks of a file.
    blocks = lines.groupBy("file", "block").agg((F.sum("size") + F.count(F.lit(1)) * len(MAGIC)).alias("bytes"))
    over_blocks = Window.partitionBy("file").orderBy("block")
    blocks = blocks.select("file", "block", (F.sum("bytes").over(over_blocks) - F.col("bytes")).alias("before"))
    inside = Window.partitionBy("file", "block").orderBy("n")
    step = F.col("size") + len(MAGIC)
    placed = lines.withColumn("inside", F.sum(step).over(inside) - step).join(blocks, ["file", "block"])
    at = F.col("before") + F.col("inside") - len(MAGIC)
    return (
        placed.withColumn("at", at)
        .where("at >= 0")
        .select("file", "block", "n", "at", (F.col("at") + len(MAGIC) + F.col("span")).alias("succ"))
    )


def _exits(pdf: pd.DataFrame) -> pd.DataFrame:
    """For every candidate of one block the first offset outside the block that its chain leads to."""
    pdf = pdf.sort_values("at")
    at = pdf["at"].to_numpy()
    target = pdf["succ"].fillna(-1).to_numpy(np.int64)
    place = np.searchsorted(at, target).clip(max=len(at) - 1)
    inner = at[place] == target
    # Chains only lead forward: pointers inside the block are doubled until all of them lead out.
    jump = np.where(inner, place, np.arange(len(at)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            break
        jump = further
    return pd.DataFrame({"file": pdf["file"], "at": at, "leads_to": target[jump]})


def _reached(pdf: pd.DataFrame) -> pd.DataFrame:
    """The records of one block that its entry's chain passes through, and the record each piece belongs to."""
    pdf = pdf.sort_values("at")
    at, succ = pdf["at"].to_numpy(), pdf["succ"].fillna(-1).to_numpy(np.int64)
    entries = pdf["entry"].to_numpy(bool)
    reached = entries.copy()
    for i in np.flatnonzero(entries):
        here = i
        while True:
            after = np.searchsorted(at, succ[here])
            if after == len(at) or at[after] != succ[here] or reached[after]:
                break
            reached[after] = True
            here = after
    owner = np.maximum.accumulate(np.where(reached, at, -1))
    return pd.DataFrame({"n": pdf["n"], "file": pdf["file"], "block": pdf["block"], "owner": owner, "at": at})


def reachable(found: DataFrame) -> DataFrame:
    """n, file, block, at, owner: pieces with the offset of the record that they belong to.

    A candidate is a record only if the chain of records from the start of its file reaches it. Inside
    a block the chains are followed at once; over the blocks of a file the remaining pointers are
    doubled, with a logarithmic number of rounds, each written to the shared folder. Pieces before a
    block's first record belong to the last record of an earlier block.
    """
    narrow = materialise(found.select("file", "block", "n", "at", "succ"), "warc-candidates")
    exits = narrow.groupBy("file", "block").applyInPandas(_exits, "file string, at long, leads_to long")
    jumps = materialise(exits.where("leads_to >= 0"), "warc-jumps")
    entries = materialise(narrow.where("at = 0").select("file", "at").distinct(), "warc-entries")
    known = entries.count()
    while True:
        ahead = entries.join(jumps, ["file", "at"]).select("file", F.col("leads_to").alias("at"))
        entries = materialise(
            entries.unionByName(ahead).distinct().join(narrow.select("file", "at"), ["file", "at"], "left_semi"),
            "warc-entries",
        )
        grown = entries.count()
        if grown == known:
            break
        known = grown
        then = columns_as(jumps, file="file", leads_to="at", after="leads_to")
        jumps = materialise(
            jumps.join(then, ["file", "leads_to"]).select("file", "at", F.col("after").alias("leads_to")), "warc-jumps"
        )
    marked = narrow.join(entries.withColumn("entered", F.lit(True)), ["file", "at"], "left")
    marked = marked.select("file", "block", "n", "at", "succ", F.coalesce("entered", F.lit(False)).alias("entry"))
    owned = marked.groupBy("file", "block").applyInPandas(
        _reached, "n long, file string, block long, owner long, at long"
    )
    owned = materialise(owned, "warc-owners")
    last = owned.groupBy("file", "block").agg(F.max("owner").alias("last"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select("file", "block", F.coalesce(F.max("last").over(earlier), F.lit(-1)).alias("carried"))
    return owned.join(carried, ["file", "block"]).select(
        "n", "file", "block", "at", F.greatest("owner", "carried").alias("owner")
    )


def _contents(pieces: DataFrame) -> DataFrame:
    """``piece`` parted into header and block (the content block as text); other columns stay."""
    head = F.substring_index("piece", _END, 1)
    length = F.regexp_extract(head, r"(?i)(?:^|\r\n)Content-Length: *([0-9]{1,9})", 1).try_cast("int")
    # In bytes, as the header counts; what follows the block are the two blank lines.
    content = F.substring(F.col("piece").cast("binary"), F.octet_length(head) + 5, length).cast("string")
    return pieces.withColumn("header", head).withColumn("block_text", content).drop("piece")


def read_archives(
    spark: SparkSession, path: str, then: Callable[[DataFrame], DataFrame] = lambda records: records
) -> DataFrame:
    """One row per record: file, at, header, block_text, or what ``then`` makes of the last two.

    ``then`` may only project; it runs where the text is read, so that a text which nobody wants is not moved
    to the place of its record. Payloads that contain the magic are put together again from their
    pieces; only those are grouped. A record must fit into one task's memory, an archive need not.
    """
    owners = reachable(candidates(spark, path))
    pieces = owners.groupBy("file", "owner").agg(F.count(F.lit(1)).alias("pieces"))
    owned = owners.join(pieces, ["file", "owner"]).where("owner >= 0")
    owned = materialise(owned.select("n", "file", "block", "at", "owner", "pieces"), "warc-owned")
    # Stored apart: its size is known, so that few pieces of such records do not make all text move.
    parted = materialise(owned.where("pieces > 1").drop("pieces"), "warc-parted")
    place = ["file", "block", "n"]
    text = _pieces(spark, path)
    whole = then(_contents(text)).join(owned.where("pieces = 1").select(*place, "at"), place)
    ordered = F.array_sort(F.collect_list(F.struct("at", "piece")))
    parts = text.join(parted, place).groupBy("file", "owner").agg(ordered.alias("parts"))
    joined = parts.select(
        "file",
        F.col("owner").alias("at"),
        F.array_join(F.transform("parts", lambda part: part["piece"]), MAGIC).alias("piece"),
    )
    return whole.drop("block", "n").unionByName(then(_contents(joined)))


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"(?i)(?:^|\r\n){name}: *([^\r]*)", 1)


def page_rows(records: DataFrame) -> DataFrame:
    """Adds page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to.

    Bytes and digest of a response are those of the payload that was read, not of its header.
    """
    revisit = _field("WARC-Type") == "revisit"
    http = F.substring_index("block_text", _END, 1)
    payload = F.substring(F.col("block_text").cast("binary"), F.octet_length(http) + 5, F.octet_length("block_text"))
    stated = F.regexp_extract(http, r"(?i)\r\nContent-Length: *([0-9]{1,18})", 1).try_cast("long")
    kept = [name for name in records.columns if name not in ("header", "block_text")]
    return records.select(
        *kept,
        _page_of(F.regexp_replace(_field("WARC-Record-ID"), "[<>]", "")).alias("page_id"),
        _field("WARC-Target-URI").alias("url"),
        F.when(~revisit, payload.cast("string")).alias("payload"),
        F.when(revisit, stated).otherwise(F.octet_length(payload).cast("long")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(_field("WARC-Payload-Digest"), "^sha1:", ""))
        .otherwise(base32_sha1(payload))
        .alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        F.when(revisit, _page_of(F.regexp_replace(_field("WARC-Refers-To"), "[<>]", ""))).alias("refers_to"),
    )


def round_trip(pages: DataFrame, compression: str = "none", **columns: str) -> DataFrame:
    """Writes ``pages`` to archives in the shared folder and reads them back; see ``page_rows``.

    Archives are plain by default, so that they are split into blocks and no task needs a whole one;
    ``compression="gzip"`` makes each one block. An empty table gives an archive without records and no
    rows. Null pages and urls are empty, repeated rows are records of their own, pages without id are never
    referred to. Texts of any length are written and read whole. Columns of ``pages`` that are not
    named are left out, whatever their names. ``session.release`` deletes the archives.
    """
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(page_records(pages, **columns), path, compression)
    return read_archives(spark, path, page_rows).drop("file", "at")


def digest(rows: DataFrame) -> DataFrame:
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, upper(sha1(coalesce(html, ''))) AS h FROM pages
), digit AS (
  SELECT *, [strpos('0123456789ABCDEF', substr(h, i, 1)) - 1 FOR i IN range(1, 42)] AS d FROM p
)
SELECT page_id, octet_length(encode(payload)) AS payload_bytes,
       array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((d[i * 5 // 4 + 1] * 16 + greatest(d[i * 5 // 4 + 2], 0)) >> (3 - i * 5 % 4)) % 32, 1) FOR i IN range(32)], '') AS payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM digit WINDOW w AS (PARTITION BY payload)
"""
