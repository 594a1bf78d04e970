"""Merkle manifest of a dataset: a hash tree for every source, a tree over the sources, a proof for every row.

A leaf's place among the leaves of its source comes from a bitmap of the source's document ids, not from
sorting leaves. The bitmap keeps its non-zero words only; above them stands a directory of row counts with
a fixed fan-out, so a place is the counts before the word plus the bits before the id within it. Every 16
consecutive nodes meet in an array by their slots and become one node of the next level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmart.llm.common import columns_as, crc32_sql, materialise

# Nodes that become one node of the next level.
RUN = 16
# A directory entry counts the rows below up to 512 entries of the next finer level.
FAN_BITS = 9
# Copies of one row that leave one row of a table together.
COPY_BLOCK = 4096
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PATH = "array<struct<before:string,after:string>>"


def _field(name: str) -> Column:
    """A value with its length, so that no two rows are written alike; ``-`` for null."""
    value = F.col(name).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(text: str) -> Column:
    return F.sha2(F.concat(*[_field(name) for name in ("doc_id", "source", "lang", "n_chars", text)]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """source, doc_id, leaf, altered: the hash of every row, and of its altered form where it has one.

    ``source`` is a key in the order of sources: ``-`` for null, else ``=`` and the value. Rows whose id has a
    checksum divisible by 5 are altered: their text's A-Z in lower case. Others and rows without id are not.
    """
    rows = columns_as(docs, doc_id="doc_id", source="source", lang="lang", n_chars="n_chars", text="text")
    rows = rows.withColumn("lowered", F.translate("text", LETTERS, LETTERS.lower()))
    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-")).alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"),
        _leaf("text").alias("leaf"),
        F.when(chosen, _leaf("lowered")).alias("altered"),
    )


def _directory(entries: DataFrame, groups: Sequence[str]) -> DataFrame:
    """groups, word -> before (rows of the group with a smaller word), total (rows of the group).

    ``entries`` has one row for each group and word with its number of rows ``n``. Counts are added up level
    by level, 512 entries to one, and come down again as sums within these 512, so that a group of any size
    is never brought together. A null word comes first.
    """
    low, high = entries.agg(F.min("word"), F.max("word")).first()
    levels = [entries.select(*groups, "word", "n")]
    while low is not None and high - low >= 1 << FAN_BITS:
        above = F.shiftright("word", FAN_BITS).alias("word")
        levels.append(levels[-1].groupBy(*groups, above).agg(F.sum("n").alias("n")))
        low, high = low >> FAN_BITS, high >> FAN_BITS
    top = Window.partitionBy(*groups)
    earlier = F.coalesce(
        F.sum("n").over(top.orderBy(F.asc_nulls_first("word")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    found = levels[-1].select(*groups, "word", earlier.alias("before"), F.sum("n").over(top).alias("total"))
    for level in levels[-2::-1]:
        own = level.withColumn("parent", F.shiftright("word", FAN_BITS))
        siblings = Window.partitionBy(*groups, "parent").orderBy(F.asc_nulls_first("word"))
        own = own.withColumn(
            "earlier", F.coalesce(F.sum("n").over(siblings.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        )
        parents = found.select(*[F.col(g).alias(f"of_{g}") for g in groups], F.col("word").alias("of_word"), "before", "total")
        same = [F.col(g).eqNullSafe(F.col(f"of_{g}")) for g in groups] + [F.col("parent").eqNullSafe(F.col("of_word"))]
        found = own.join(parents, reduce(lambda a, b: a & b, same)).select(
            *groups, "word", (F.col("before") + F.col("earlier")).alias("before"), "total"
        )
    return found


def bitmap_index(rows: DataFrame) -> DataFrame:
    """source, word, bits, extra, before, total: the compressed bitmaps of ids with their counts.

    A word holds 64 ids, and only words with an id are stored. ``extra`` lists the bits that stand for more
    than one row, with the number of further rows.
    """
    ids = rows.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    ids = ids.select(
        "source", F.shiftright("doc_id", 6).alias("word"), F.expr("cast(doc_id & 63L AS int)").alias("bit"), "rows"
    )
    more = F.when(F.col("rows") > 1, F.struct("bit", (F.col("rows") - 1).alias("rows")))
    words = materialise(
        ids.groupBy("source", "word").agg(
            F.expr("bit_or(shiftleft(1L, bit))").alias("bits"),
            F.collect_list(more).alias("extra"),
            F.sum("rows").alias("n"),
        ),
        "merkle-words",
    )
    placed = _directory(words, ["source"]).select(
        F.col("source").alias("of_source"), F.col("word").alias("of_word"), "before", "total"
    )
    same = (F.col("source") == F.col("of_source")) & F.col("word").eqNullSafe(F.col("of_word"))
    return materialise(
        words.join(placed, same).select("source", "word", "bits", "extra", "before", "total"), "merkle-index"
    )


def coordinates(rows: DataFrame, index: DataFrame) -> DataFrame:
    """Every leaf with its place among those of its source (``index``) and their number (``n``).

    Leaves ascend by doc_id, a null one first; rows of one id ascend by their hashes.
    """
    bit = F.expr("cast(doc_id & 63L AS int)")
    held = index.select(F.col("source").alias("of_source"), F.col("word").alias("of_word"), "bits", "extra", "before", "total")
    same = (F.col("source") == F.col("of_source")) & F.col("word").eqNullSafe(F.col("of_word"))
    below = F.coalesce(F.expr("bit_count(bits & ~shiftleft(-1L, bit))"), F.lit(0))
    repeats = F.aggregate(
        F.filter("extra", lambda e: e["bit"] < F.col("bit")), F.lit(0).cast("long"), lambda total, e: total + e["rows"]
    )
    placed = (
        rows.withColumn("word", F.shiftright("doc_id", 6))
        .withColumn("bit", bit)
        .join(held, same)
        .select(
            "source", "doc_id", "leaf", "altered",
            (F.col("before") + below + repeats).alias("index"),
            F.col("total").alias("n"),
            F.exists("extra", lambda e: e["bit"].eqNullSafe(F.col("bit"))).alias("shared"),
        )
    )
    if index.where(F.size("extra") > 0).isEmpty():
        return placed.drop("shared")
    placed = materialise(placed, "merkle-places")
    return placed.where("NOT shared").drop("shared").unionByName(_apart(placed.where("shared").drop("shared")))


def _apart(shared: DataFrame) -> DataFrame:
    """Places of rows that share their source and id: by their hashes, equal rows one after the other."""
    keys = ["source", "doc_id"]
    equal = materialise(
        shared.groupBy(*keys, "leaf").agg(
            F.first("altered").alias("altered"), F.first("index").alias("index"), F.first("n").alias("total"),
            F.count(F.lit(1)).alias("n"), F.expr("cast(conv(first(substring(leaf, 1, 15)), 16, 10) AS long)").alias("word"),
        ),
        "merkle-equal",
    )
    counted = equal.groupBy(*keys, "word").agg(F.sum("n").alias("n"))
    held = _directory(materialise(counted, "merkle-equal-words"), keys).select(
        *[F.col(c).alias(f"of_{c}") for c in (*keys, "word")], "before"
    )
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*keys, "word")]
    # Two hashes that start with the same 60 bits.
    alike = Window.partitionBy(*keys, "word").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    first = F.col("index") + F.col("before") + F.coalesce(F.sum("n").over(alike), F.lit(0))
    starts = equal.join(held, reduce(lambda a, b: a & b, same)).select(
        *keys, "leaf", "altered", F.col("total"), first.alias("index"), F.col("n").alias("copies")
    )
    blocks = starts.withColumn("block", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPY_BLOCK})")))
    blocks = blocks.repartition(*keys, "leaf", "block")
    within = F.explode(F.expr(f"sequence(block * {COPY_BLOCK}, least(copies, (block + 1) * {COPY_BLOCK}) - 1)"))
    return blocks.withColumn("copy", within).select(
        *keys, "leaf", "altered", (F.col("index") + F.col("copy")).alias("index"), F.col("total").alias("n")
    )


def _runs(nodes: DataFrame, payload: Sequence[str]) -> DataFrame:
    """source, index, n, slots, digest: the runs of 16 consecutive nodes of groups with several.

    ``nodes`` has source, index, n (nodes of the group), digest and the columns of ``payload``.
    """
    slot = (F.col("index") % RUN).cast("int").alias("slot")
    runs = (
        nodes.where("n > 1")
        .groupBy("source", F.expr(f"index div {RUN}").alias("index"))
        .agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(slot, "digest", *payload))).alias("slots"))
    )
    return runs.withColumn("digest", F.sha2(F.array_join(F.col("slots.digest"), ""), 256))


def _levels(nodes: DataFrame, most: int, payload: Sequence[str] = ()) -> tuple[list[DataFrame], list[DataFrame]]:
    """The stored runs of every level, and what is at the top of the groups that end at each (source, digest)."""
    levels, tops = [], [nodes.where("n = 1").select("source", "digest")]
    while most > 1:
        runs = materialise(_runs(nodes, payload), "merkle-runs")
        levels.append(runs)
        nodes = runs.select("source", "index", F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), "digest")
        tops.append(nodes.where("n = 1").select("source", "digest"))
        most, payload = -(-most // RUN), ()
    return levels, tops


def _around(slots: str, slot: Column) -> Column:
    """The digests before and after a slot of a run, as one text each."""
    digests = F.col(f"{slots}.digest")
    return F.struct(
        F.array_join(F.slice(digests, F.lit(1), slot), "").alias("before"),
        F.array_join(F.slice(digests, slot + 2, F.lit(RUN)), "").alias("after"),
    )


def _upper(levels: list[DataFrame], outer: DataFrame) -> DataFrame | None:
    """source, index, path, and what else ``outer`` has: what is above every run of the first level.

    ``outer`` has one row a group: source, path above its top, further columns. Level by level the path of a
    run goes to its nodes, one step longer. Only runs carry paths, a sixteenth of the nodes.
    """
    carried = [name for name in outer.columns if name not in ("source", "path")]
    above = None
    for i in range(len(levels) - 1, -1, -1):
        last = levels[i].where(f"n <= {RUN}").select("source", "index").join(outer, "source")
        last = last.select("source", "index", "path", *carried)
        above = last if above is None else above.unionByName(last)
        if i == 0:
            break
        step = levels[i].join(above, ["source", "index"]).select(
            "source", "index", "slots", "path", *carried, F.posexplode(F.col("slots.digest")).alias("slot", "own")
        )
        above = step.select(
            "source",
            (F.col("index") * RUN + F.col("slot")).alias("index"),
            F.concat(F.array(_around("slots", F.col("slot"))), F.col("path")).alias("path"),
            *carried,
        )
    return above


def _in_order(tops: DataFrame) -> DataFrame:
    """The groups' tops with their places in the order of the sources: source, index, n, digest.

    Sources are sorted in ranges, and places count on from range to range; only the ranges' sizes meet.
    """
    ranged = tops.repartitionByRange("source").sortWithinPartitions("source")
    ranged = materialise(ranged.withColumn("place", F.monotonically_increasing_id()), "merkle-sources")
    part = F.shiftright("place", 33).alias("part")
    sizes = ranged.groupBy(part).agg(F.count(F.lit(1)).alias("n"))
    earlier = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("part", F.coalesce(earlier, F.lit(0)).alias("earlier"), F.sum("n").over(Window.partitionBy()).alias("n"))
    index = F.col("earlier") + F.expr("place & 8589934591L")
    return ranged.withColumn("part", part).join(sizes, "part").select("source", index.alias("index"), "n", "digest")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of ``docs``.

    Every row is a leaf, also a repeated one: leaves of a source ascend by doc_id (null first), rows of one id
    by their hashes, and equal rows are neighbours. Null fields are hashed as ``-`` and differ from empty
    ones; a null source is a group of its own, before all others. A source with one row has its leaf as
    subroot, a single source's subroot is the root. Texts of any length are hashed whole inside one task each.
    An empty table gives no rows. Other columns are ignored, whatever their names.

    A source may hold any share of the rows: all work is keyed by (source, word of 64 ids) or (source, run of
    16 nodes). Rows of one id, equal ones too, are numbered by counts. Tables grow by a sixteenth with each level.
    """
    found = materialise(leaves(docs), "merkle-leaves")
    index = bitmap_index(found)
    most = index.agg(F.max("total")).first()[0] or 0
    nodes = coordinates(found, index).withColumnRenamed("leaf", "digest")
    alone = nodes.where("n = 1")
    levels, tops = _levels(nodes, most, ("doc_id", "altered"))
    subroots = materialise(reduce(DataFrame.unionByName, tops), "merkle-subroots")

    # The tree over the sources is one more group, whose nodes are the subroots.
    sources = materialise(_in_order(subroots), "merkle-order")
    ordered = sources.select(F.lit("").alias("source"), "index", "n", "digest")
    upper, ends = _levels(ordered, sources.count())
    root = reduce(DataFrame.unionByName, ends)
    nothing = F.array().cast(PATH)
    outer = _upper(upper, root.select("source", nothing.alias("path"), F.col("digest").alias("root")))
    if outer is None:
        paths = sources.select("source", F.col("digest").alias("subroot"), nothing.alias("path"), F.col("digest").alias("root"))
    else:
        step = upper[0].join(outer, ["source", "index"]).select(
            "index", "slots", "path", "root", F.posexplode(F.col("slots.digest")).alias("slot", "own")
        )
        step = step.select(
            (F.col("index") * RUN + F.col("slot")).alias("index"),
            F.concat(F.array(_around("slots", F.col("slot"))), F.col("path")).alias("path"),
            "root",
        )
        paths = sources.join(step, "index").select("source", F.col("digest").alias("subroot"), "path", "root")
    paths = materialise(paths, "merkle-paths")

    single = alone.join(paths, "source").select("doc_id", F.col("digest").alias("leaf"), "altered", "path", "subroot", "root")
    above = _upper(levels, paths)
    if above is None:
        return _proved(single)
    own = F.col("slots")[F.col("slot")]
    inside = levels[0].join(above, ["source", "index"])
    inside = inside.withColumn("slot", F.explode(F.expr("sequence(0, size(slots) - 1)"))).select(
        own["doc_id"].alias("doc_id"),
        own["digest"].alias("leaf"),
        own["altered"].alias("altered"),
        F.concat(F.array(_around("slots", F.col("slot"))), F.col("path")).alias("path"),
        "subroot",
        "root",
    )
    return _proved(inside.unionByName(single))


def _proved(rows: DataFrame) -> DataFrame:
    """The digest of each row's proof, and the root that its altered or own leaf leads to."""
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["before"], step["after"])), "")
    folded = F.aggregate(
        "path",
        F.coalesce("altered", "leaf"),
        lambda node, step: F.sha2(F.concat(step["before"], node, step["after"]), 256),
    )
    proved = rows.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root")
    )
    return proved.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::varchar) || ':' || {f}, '-')" for f in fields) + ")"


# Trees as lists of levels; a proof climbs from level to level.
SQL = f"""
WITH RECURSIVE lowered AS (
  SELECT *, translate(text, '{LETTERS}', '{LETTERS.lower()}') AS small FROM documents
),
leaves AS (
  SELECT doc_id, coalesce('=' || source, '-') AS source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {crc32_sql("doc_id")} % 5 = 0 THEN {_leaf_sql("small")} ELSE {_leaf_sql("text")} END AS altered
  FROM lowered
),
placed AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves),
tree AS (
  SELECT source, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY source
  UNION ALL
  SELECT source, level + 1,
         list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))
  FROM tree WHERE len(nodes) > 1
),
subroots AS (
  SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY encode(source)) - 1 AS place
  FROM tree WHERE len(nodes) = 1
),
top AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots HAVING count(*) > 0
  UNION ALL
  SELECT level + 1, list_transform(range(0, len(nodes), 16), lambda i: sha256(array_to_string(nodes[i + 1:i + 16], '')))
  FROM top WHERE len(nodes) > 1
),
climb AS (
  SELECT doc_id, source, leaf, place AS own, place, 0 AS level, false AS upper, altered AS node, '' AS proof FROM placed
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, c.own,
         CASE WHEN len(coalesce(t.nodes, u.nodes)) > 1 THEN c.place // 16 ELSE s.place END,
         CASE WHEN len(coalesce(t.nodes, u.nodes)) > 1 THEN c.level + 1 ELSE 0 END,
         c.upper OR len(t.nodes) = 1,
         CASE WHEN len(coalesce(t.nodes, u.nodes)) > 1 THEN sha256(
           array_to_string(coalesce(t.nodes, u.nodes)[c.place // 16 * 16 + 1:c.place], '') || c.node
           || array_to_string(coalesce(t.nodes, u.nodes)[c.place + 2:c.place // 16 * 16 + 16], '')) ELSE c.node END,
         CASE WHEN len(coalesce(t.nodes, u.nodes)) > 1 THEN c.proof
           || array_to_string(coalesce(t.nodes, u.nodes)[c.place // 16 * 16 + 1:c.place], '')
           || array_to_string(coalesce(t.nodes, u.nodes)[c.place + 2:c.place // 16 * 16 + 16], '') ELSE c.proof END
  FROM climb c
  JOIN subroots s ON s.source = c.source
  LEFT JOIN tree t ON NOT c.upper AND t.source = c.source AND t.level = c.level
  LEFT JOIN top u ON c.upper AND u.level = c.level
  WHERE len(coalesce(t.nodes, u.nodes)) > 1 OR NOT c.upper
)
SELECT c.doc_id, c.leaf, s.subroot, r.nodes[1] AS root, sha256(c.proof) AS proof_sha256, c.node AS folded_root,
       c.node = r.nodes[1] AS verified
FROM climb c JOIN subroots s ON s.source = c.source
JOIN top r ON len(r.nodes) = 1 AND c.upper AND c.level = r.level
"""
