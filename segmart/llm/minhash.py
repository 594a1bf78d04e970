"""Near duplicates: minimum hashes, banding, verification on full sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segmart.llm.common import LOWER, columns_as, free_name, materialise, named
from segmart.llm.components import components

WORDS = 5
_ROW_BATCH = 256


@dataclass(frozen=True)
class NearSettings:
    """Documents are linked with 100 * intersection >= ``percent`` * union of their shingle sets.

    A pair at 85 % agrees in a given band with 0.85**6 = 0.377, so it shares none of 32 with 3e-7. The
    signature test lets through what agrees in ``signature_share`` of the minima, 5.8 standard
    deviations below 85 %.
    """

    percent: int = 85
    bands: int = 32
    rows: int = 6
    signature_share: float = 0.70
    seed: int = 20_240_229
    # Rows of one bucket compared with one another in one task.
    block_rows: int = 512

    @property
    def minima(self) -> int:
        return self.bands * self.rows


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles of a text; of the whole sequence if shorter."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    count = len(words) - WORDS + 1
    mixed = np.zeros(count, np.uint64)
    for place in range(WORDS):
        # Each place has an odd multiplier of its own; the fold between places keeps their order apart.
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[place : place + count]
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def _families(settings: NearSettings) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add-shift hashing: the upper half of a * x + b is universal for odd random a."""
    draw = np.random.default_rng(settings.seed)
    a = draw.integers(0, 1 << 63, settings.minima, np.uint64) * np.uint64(2) + np.uint64(1)
    return a, draw.integers(0, 1 << 63, settings.minima, np.uint64)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of every hash function over the set, cut to 16 bits."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 512):
        np.minimum(least, (shingles[start : start + 512, None] * a + b).min(axis=0), out=least)
    # The minima of large sets are small numbers: mix before the cut.
    least *= np.uint64(0xD6E8FEB86659FD93)
    return (least >> np.uint64(48)).astype("<u2")


def sketches(docs: DataFrame, settings: NearSettings) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit hash of the sorted set), signature; keys null for empty sets.

    A column text_key of ``docs`` is passed on.
    """
    also = [name for name in ("text_key",) if name in docs.columns]

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _families(settings)
        for whole in batches:
            for start in range(0, whole.num_rows, _ROW_BATCH):
                batch = whole.slice(start, _ROW_BATCH)
                counts, keys, signatures = [], [], []
                for text in batch.column(1).to_pylist():
                    shingles = shingle_set(text)
                    counts.append(len(shingles))
                    if len(shingles):
                        keys.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                        signatures.append(signature(shingles, a, b).tobytes())
                    else:
                        keys.append(None)
                        signatures.append(None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array(counts, pa.int64()),
                        pa.array(keys, pa.binary()),
                        pa.array(signatures, pa.binary()),
                        *[batch.column(2 + i) for i in range(len(also))],
                    ],
                    ["doc_id", "n_shingles", "set_key", "signature", *also],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    more = "".join(f", {name} {docs.schema[name].dataType.simpleString()}" for name in also)
    return docs.select("doc_id", "text", *also).mapInArrow(
        sketch, f"doc_id {kind}, n_shingles long, set_key binary, signature binary{more}"
    )


def _bands(signature_column: Column, settings: NearSettings) -> Column:
    width = 2 * settings.rows
    return F.array(
        *[F.xxhash64(F.lit(i), F.substring(signature_column, 1 + i * width, width)) for i in range(settings.bands)]
    )


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    least, most = sorted((len(x), len(y)))
    if 100 * least < percent * most:
        return False
    common = np.intersect1d(x, y, assume_unique=True).size
    return 100 * common >= percent * (least + most - common)


def _agreeing(settings: NearSettings):
    """Share of equal minima of two signatures, over batches of pairs."""
    least = settings.signature_share * settings.minima

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            left, right = (
                np.frombuffer(b"".join(batch.column(name).to_pylist()), "<u2").reshape(batch.num_rows, -1)
                for name in ("left_signature", "right_signature")
            )
            passed = pa.array((left == right).sum(axis=1) >= least)
            kept = batch.filter(passed)
            yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b")], ["a", "b"])

    return agree


def _verified(settings: NearSettings):
    """Links that hold on the full sets."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROW_BATCH):
                a, b = [], []
                for row in whole.slice(start, _ROW_BATCH).to_pylist():
                    left, right = (np.frombuffer(row[name], np.uint64) for name in ("left_set", "right_set"))
                    if _linked(left, right, settings.percent):
                        a.append(row["a"])
                        b.append(row["b"])
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return verify


def _block_links(settings: NearSettings):
    """Links inside one block of a bucket: each open row against every row of another component.

    Only links that join components are returned, a forest, never all pairs of the block.
    """

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.drop_duplicates(["set_key", "asks"])
        members, asking = rows[~rows["asks"]], rows[rows["asks"]]
        if members.empty or asking.empty:
            return pd.DataFrame({"a": [], "b": []})
        sets = [np.frombuffer(x, np.uint64) for x in members["shingles"]]
        sizes = np.array([len(x) for x in sets])
        flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        roots, keys = members["root"].tolist(), members["set_key"].tolist()
        joined: dict[bytes, bytes] = {}

        def top(root: bytes) -> bytes:
            while root in joined:
                root = joined[root]
            return root

        found = []
        for key, root, packed in zip(asking["set_key"], asking["root"], asking["shingles"], strict=True):
            mine = np.frombuffer(packed, np.uint64)
            near = np.searchsorted(mine, flat).clip(max=len(mine) - 1)
            common = np.add.reduceat((mine[near] == flat).astype(np.int64), starts)
            hits = np.flatnonzero(100 * common >= settings.percent * (sizes + len(mine) - common))
            for hit in hits:
                here, there = top(root), top(roots[hit])
                if here != there:
                    joined[max(here, there)] = min(here, there)
                    found.append((key, keys[hit]))
        return pd.DataFrame(found, columns=["a", "b"])

    return links


def _shingles(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """set_key, shingles of the wanted documents (doc, set_key).

    The only time that texts are shuffled. A text whose set is not the expected one belongs to another
    document of that id and is left out.
    """

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _ROW_BATCH):
                keys, sets = [], []
                for key, text in zip(*(whole.slice(start, _ROW_BATCH).column(n).to_pylist() for n in (0, 1)), strict=True):
                    packed = shingle_set(text).tobytes()
                    if xxhash.xxh3_128_digest(packed) == key:
                        keys.append(key)
                        sets.append(packed)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["set_key", "shingles"]
                )

    # Never a broadcast, also where the list happens to be short: the plan is the same at every size.
    texts = columns_as(docs, doc="doc_id", text="text").join(wanted.hint("merge"), "doc").select("set_key", "text")
    expanded = texts.mapInArrow(expand, "set_key binary, shingles binary")
    return expanded.groupBy("set_key").agg(F.first("shingles").alias("shingles"))


def near_links(docs: DataFrame, classes: DataFrame, settings: NearSettings) -> tuple[DataFrame, DataFrame]:
    """(a, b) links between set keys that join what is connected, and node -> root of their components.

    ``classes``: set_key, doc, signature; one row per distinct set. In every bucket of every band the
    member with the most bucket mates is the centre: copies of one original meet in its buckets. All
    members are compared with the centre, by signature and then on full sets. What a bucket then holds
    outside the centre's component is compared with all its members of other components, in blocks,
    so every pair that shares a bucket is either compared or known to be connected.
    """
    keyed = classes.select("set_key", "doc", F.explode(_bands(F.col("signature"), settings)).alias("bucket"))
    # Sizes are stored before the join: it can split a hot bucket then, which it cannot beside an aggregate.
    sizes = materialise(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "near-sizes")
    members = materialise(keyed.join(sizes, "bucket"), "near-members")
    mates = members.groupBy("set_key").agg(F.sum("size").alias("mates"))
    ranked = members.join(mates, "set_key")
    # Ties go to the smallest key.
    best = ranked.groupBy("bucket").agg(F.min(F.struct(-F.col("mates"), "set_key")).alias("best"))
    centres = materialise(best.select("bucket", "best.set_key"), "near-centres")
    centre = columns_as(centres, bucket="bucket", a="set_key")
    pairs = (
        members.join(centre, "bucket")
        .where(F.col("a") != F.col("set_key"))
        .select("a", F.col("set_key").alias("b"))
        .distinct()
    )
    signatures = classes.select("set_key", "signature")
    signed = (
        pairs.join(columns_as(signatures, b="set_key", right_signature="signature"), "b")
        .join(columns_as(signatures, a="set_key", left_signature="signature"), "a")
        .select("a", "b", "left_signature", "right_signature")
    )
    alike = signed.mapInArrow(_agreeing(settings), "a binary, b binary")
    sets = materialise(_shingles(members.select("doc", "set_key").distinct(), docs), "near-sets")
    compared = alike.join(columns_as(sets, b="set_key", right_set="shingles"), "b").join(
        columns_as(sets, a="set_key", left_set="shingles"), "a"
    )
    links = materialise(compared.mapInArrow(_verified(settings), "a binary, b binary"), "near-links")
    roots = materialise(components(links), "near-roots")

    more = materialise(_completing(sets, members, centres, roots, settings), "near-more")
    if more.isEmpty():
        return links, roots
    every = links.unionByName(more)
    return every, materialise(components(every), "near-roots")


def _completing(
    sets: DataFrame, members: DataFrame, centres: DataFrame, roots: DataFrame, settings: NearSettings
) -> DataFrame:
    """Links (a, b) that the centres did not show, a spanning forest for each block of a bucket."""
    placed = members.join(columns_as(roots, set_key="node", known="root"), "set_key", "left").withColumn(
        "root", F.coalesce("known", "set_key")
    )
    centre = columns_as(centres, bucket="bucket", centre="set_key").join(
        columns_as(roots, centre="node", centre_known="root"), "centre", "left"
    )
    centre = centre.select("bucket", "centre", F.coalesce("centre_known", "centre").alias("centre_root"))
    # The centre was compared with everyone. Buckets in which all others are of its component are done.
    rest = placed.join(centre, "bucket").where(F.col("set_key") != F.col("centre"))
    rest = rest.select("bucket", "set_key", "root", (F.col("root") != F.col("centre_root")).alias("outside"))
    state = rest.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("others"),
        F.sum(F.col("outside").cast("long")).alias("outsiders"),
        F.min("root").alias("first_root"),
        F.max("root").alias("last_root"),
    )
    undecided = state.where("others > 1 AND outsiders > 0 AND first_root != last_root")
    size = F.lit(settings.block_rows)
    undecided = undecided.select(
        "bucket",
        F.ceil(F.col("others") / size).cast("int").alias("member_blocks"),
        F.ceil(F.col("outsiders") / size).cast("int").alias("asking_blocks"),
    )
    asked = materialise(rest.join(materialise(undecided, "near-open"), "bucket"), "near-undecided")

    def blocks(df: DataFrame, own: str, others: str, asks: bool) -> DataFrame:
        mine = F.pmod(F.xxhash64("set_key"), named(own)).cast("int")
        beside = F.explode(F.sequence(F.lit(0), named(others) - 1))
        first, second = ("member", "asking") if not asks else ("asking", "member")
        return df.select(
            "bucket", "set_key", "root", F.lit(asks).alias("asks"), mine.alias(first), beside.alias(second)
        )

    spread = blocks(asked, "member_blocks", "asking_blocks", False).unionByName(
        blocks(asked.where("outside"), "asking_blocks", "member_blocks", True)
    )
    return (
        spread.join(sets, "set_key")
        .select("bucket", "member", "asking", "set_key", "root", "asks", "shingles")
        .groupBy("bucket", "member", "asking")
        .applyInPandas(_block_links(settings), "a binary, b binary")
        .distinct()
    )


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    settings: NearSettings | None = None,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id that links lead to, the document's own included, and ``kept``
    says that it is the document's own. Equal sets are one node from the start, so copies of a text
    cost no comparison. A null text, or one without words, has an empty set and is linked with nothing.
    A row without id stands alone: component_id null, kept. Repeated rows get the same result, and
    rows of one id with different texts are placed by their texts. An empty table gives no rows.
    """
    return _placed(columns_as(docs, doc_id=id_column, text=text_column), settings or NearSettings())


def _placed(source: DataFrame, settings: NearSettings) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row (doc_id, text), and text_key where there is one."""
    sketched = materialise(sketches(source, settings), "near-sketches")
    named_rows = sketched.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    classes = materialise(
        named_rows.groupBy("set_key").agg(F.min("doc_id").alias("doc"), F.first("signature").alias("signature")),
        "near-classes",
    )
    _, roots = near_links(source.select("doc_id", "text").where("doc_id IS NOT NULL"), classes, settings)
    ids = classes.select("set_key", "doc").join(columns_as(roots, set_key="node", root="root"), "set_key", "left")
    ids = ids.withColumn("root", F.coalesce("root", "set_key"))
    least = ids.groupBy("root").agg(F.min("doc").alias("component"))
    component = ids.join(least, "root").select("set_key", "component")
    return sketched.join(component, "set_key", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("set_key").isNull() | F.col("doc_id").isNull(), F.col("doc_id"))
        .otherwise(F.col("component"))
        .alias("component_id"),
        (
            F.col("set_key").isNull() | F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component"))
        ).alias("kept"),
        *[name for name in ("text_key",) if name in sketched.columns],
    )


def drop_near_copies(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    settings: NearSettings | None = None,
) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; one document of each component.

    Of rows of one id with different texts only those go that `near_duplicates` does not keep.
    """
    text_key = F.unhex(F.md5(F.col("text")))
    source = columns_as(docs, doc_id=id_column, text=text_column).withColumn("text_key", text_key)
    dropped = _placed(source, settings or NearSettings()).where(~F.col("kept"))
    doc, key = free_name(docs, "dropped_doc"), free_name(docs, "dropped_text")
    dropped = dropped.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).distinct()
    same = (named(id_column) == named(doc)) & (F.unhex(F.md5(named(text_column))) == named(key))
    return docs.join(dropped, same, "left_anti")
