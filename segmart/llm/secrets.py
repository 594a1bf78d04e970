"""Secrets: fixed patterns, and opaque values that only few owners hold. Native expressions only."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmart.llm.common import free_name, materialise, named


@dataclass(frozen=True)
class Pattern:
    """``group`` is the part whose length counts and whose value identifies the secret."""

    kind: str
    regex: str
    group: int
    least: int


BASE = (
    Pattern(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Pattern("access", r"AKIA[A-Z0-9]+", 0, 18),
    # Only runs of full length match, so that ordinary words yield nothing to sort out.
    Pattern("hex", r"[0-9a-f]{16,}", 0, 16),
)
# Long values of letters and digits without an own pattern. Most are names, paths or quoted examples;
# their owners tell which are not.
OPAQUE = Pattern("opaque", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}", 0, 20)

KINDS = tuple(pattern.kind for pattern in (*BASE, OPAQUE))

# A value held by more owners than this is a copied example.
MAX_OWNERS = 2


_FINDING = "struct<kind:string,start:int,end:int,value:string,n_owners:long,n_repositories:long,live:boolean>"


def _pieces(text: Column, pattern: Pattern) -> Column:
    """array<struct<kind, gap, match, value>>: each match after the gap before it, in text order."""
    gaps = F.transform(F.split(text, pattern.regex, -1), lambda gap: F.char_length(gap))
    matches = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern.regex), F.lit(pattern.group))
    pieces = F.transform(
        F.arrays_zip(matches.alias("match"), values.alias("value")),
        lambda piece, i: F.struct(
            F.lit(pattern.kind).alias("kind"),
            i.alias("i"),
            F.get(gaps, i).alias("gap"),
            F.char_length(piece["match"]).alias("width"),
            piece["value"].alias("value"),
        ),
    )
    none = F.expr("cast(array() as array<struct<kind:string,i:int,gap:int,width:int,value:string>>)")
    return F.when(F.regexp_like(text, F.lit(pattern.regex)), pieces).otherwise(none)


def matches(docs: DataFrame, text_column: str, *keep: Column) -> DataFrame:
    """``keep`` plus the pieces of every pattern, in one scan of the texts."""
    text = F.coalesce(named(text_column), F.lit(""))
    return docs.select(*keep, F.concat(*[_pieces(text, pattern) for pattern in (*BASE, OPAQUE)]).alias("pieces"))


def spans(matched: DataFrame, *keep: str) -> DataFrame:
    """row, ``keep``, kind, start, end, value; one row per match that is long enough.

    Code points, end exclusive. Widths and gaps add up to the places, a running sum within one text.
    Opaque values that overlap a match of a fixed pattern are left out.
    """
    flat = matched.where(F.size("pieces") > 0).select("row", *keep, F.inline("pieces"))
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    least = F.create_map(*[F.lit(x) for p in (*BASE, OPAQUE) for x in (p.kind, p.least)])
    placed = (
        flat.withColumn("end", F.sum(F.col("gap") + F.col("width")).over(along).cast("int"))
        .withColumn("start", F.col("end") - F.col("width"))
        .where(F.char_length("value") >= least[F.col("kind")])
    )
    fixed = F.col("kind") != OPAQUE.kind
    before = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("row").orderBy("start").rangeBetween(0, Window.unboundedFollowing)
    reaches = F.max(F.when(fixed, F.col("end"))).over(before) > F.col("start")
    follows = F.min(F.when(fixed, F.col("start"))).over(after) < F.col("end")
    overlaps = F.coalesce(reaches, F.lit(False)) | F.coalesce(follows, F.lit(False))
    return (
        placed.withColumn("hidden", ~fixed & overlaps)
        .where(~F.col("hidden"))
        .select("row", *keep, "kind", "start", "end", "value")
    )


def ownership(found: DataFrame) -> DataFrame:
    """value_hash, n_owners, n_repositories over all findings of the corpus.

    ``found``: value_hash, owner, repository. The distinct triples are formed before the shuffle, so a
    value that a third of all documents quote is a row for each task and owner. A null owner or
    repository counts as one more.
    """
    held = found.select("value_hash", "owner", "repository").distinct()
    per_owner = held.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("value_hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("n").alias("n_repositories")
    )


def secret_scan(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    owner_column: str = "source",
    repository: Sequence[str] = ("source", "lang"),
    max_owners: int = MAX_OWNERS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, findings (by start, then kind), an array of
    (kind, start, end, value, n_owners, n_repositories, live).

    Every match of the fixed patterns is a finding, and so is every opaque value that overlaps none of
    them. The corpus judges them: hashes of all values are counted by distinct owner and repository, and
    a value that at most ``max_owners`` owners hold is live, any other a copied example. Null text
    counts as empty, a null owner as an owner of its own. Rows with equal ids are scanned and returned
    one by one; an empty table gives no rows.

    The texts are scanned once; after that only findings move. A value that very many rows hold is
    spread by the adaptive split of its join, which needs no rows of a value together.
    """
    source = docs.select(
        named(id_column).alias("doc_id"),
        named(text_column).alias("text"),
        named(owner_column).cast("string").alias("owner"),
        F.xxhash64(*[named(name) for name in repository]).alias("repository"),
    )
    row = F.monotonically_increasing_id().alias("row")
    # The row number is written with the rows, so it stays the same when a task is run again.
    matched = materialise(matches(source, "text", row, "doc_id", "owner", "repository"), "secret-matches")
    found = spans(matched, "owner", "repository").withColumn("value_hash", F.sha2("value", 256))
    judged = found.join(materialise(ownership(found), "secret-owners"), "value_hash").withColumn("live", F.col("n_owners") <= max_owners)
    rank = F.array_position(F.lit(list(KINDS)), F.col("kind"))
    entry = F.struct("start", rank.alias("rank"), "kind", "end", "value", "n_owners", "n_repositories", "live")
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    fields = ("kind", "start", "end", "value", "n_owners", "n_repositories", "live")
    listed = F.transform("entries", lambda e: F.struct(*[e[name].alias(name) for name in fields]))
    return matched.join(per_row, "row", "left").select(
        "doc_id", F.coalesce(listed, F.expr(f"cast(array() as array<{_FINDING}>)")).alias("findings")
    )


def _listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(scan: DataFrame) -> DataFrame:
    """doc_id, the counts of the fixed kinds, and the spans: fixed ones, and those with live opaque ones."""
    fixed = F.filter("findings", lambda s: s["kind"] != OPAQUE.kind)
    reported = F.filter("findings", lambda s: (s["kind"] != OPAQUE.kind) | s["live"])

    def count(test: Callable[[Column], Column]) -> Column:
        return F.size(F.filter("findings", test)).cast("long")

    def of_kind(kind: str) -> Column:
        return count(lambda s: s["kind"] == kind).alias(f"n_{kind}")

    return scan.select(
        "doc_id",
        *[of_kind(pattern.kind) for pattern in BASE],
        F.sha2(_listed(fixed), 256).alias("base_sha256"),
        _listed(reported).alias("spans"),
        count(lambda s: s["live"]).alias("n_live"),
        count(lambda s: ~s["live"]).alias("n_examples"),
    )


MASK = "[SECRET]"


def redact_live(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    length_column: str = "n_chars",
    **options,
) -> DataFrame:
    """``docs`` with ``MASK`` for the value of every live finding; copied examples stay.

    Rows that share an id share their findings. ``length_column``, where there is one, follows the
    text. The longest values go first, so that a part of a value never breaks it up.
    """
    live = secret_scan(docs, id_column, text_column, **options).select(
        "doc_id", F.filter("findings", lambda s: s["live"]).alias("findings")
    )
    values_name, owner_name = free_name(docs, "live_values"), free_name(docs, "finding_doc")
    value = F.col("finding.value")
    values = (
        live.select("doc_id", F.explode("findings").alias("finding"))
        .groupBy(F.col("doc_id").alias(owner_name))
        .agg(F.collect_set(F.struct((-F.char_length(value)).alias("shortness"), value.alias("value"))).alias(values_name))
    )
    masked = F.aggregate(
        F.array_sort(named(values_name)),
        named(text_column),
        lambda text, entry: F.replace(text, entry["value"], F.lit(MASK)),
    )
    joined = docs.join(values, named(id_column).eqNullSafe(named(owner_name)), "left")
    changed = named(values_name).isNotNull()
    changes = {text_column: F.when(changed, masked).otherwise(named(text_column))}
    if length_column in docs.columns:
        changes[length_column] = F.when(changed, F.char_length(masked)).otherwise(named(length_column))
        changes[length_column] = changes[length_column].cast(docs.schema[length_column].dataType)
    return joined.withColumns(changes).select(*[named(name) for name in docs.columns])
