"""Prefix trie of conversations: which turns they share from the start, and what sharing them saves.

A conversation is the sequence of its turns' 128-bit digests, as one binary value whose order keeps equal
prefixes together. Sequences are dealt in ranges of that order, so a node of the trie lies in one range or
in neighbouring ones. Each range is sorted and cut into nodes with numpy; nodes on the path of its first
or last conversation may go on in another range and are put together afterwards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmart.llm.common import columns_as, crc32_sql, materialise

WORDS = r"[^\x20\x09-\x0D]+"
# Turns in one padded matrix; only longer conversations take part in the next.
WIDTH = 8
# Conversations in a range, about.
RANGE_ROWS = 100_000
GROUP = 20

NODES = (
    "part long, side int, depth long, through boolean, key binary, parent_key binary, parent_side int, conv_id long,"
    " parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends binary, ends_sha256 string"
)
NOTHING = hashlib.sha256(b"").hexdigest()


def turn_digest() -> Column:
    """128 bits of the SHA-256 of role and text, with the role's length before them."""
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return F.substring(F.sha2(whole, 256), 1, 32)


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (digest and words of each, in order) of every conversation that has an id."""
    rows = columns_as(conversations, conv_id="conv_id", turn="turn", role="role", text="text").where("conv_id IS NOT NULL")
    rows = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        *[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("role", "text")],
    ).select("conv_id", "turn", turn_digest().alias("digest"), F.regexp_count("text", F.lit(WORDS)).cast("long").alias("words"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "digest", "words")))
    return rows.groupBy("conv_id").agg(
        F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns")
    )


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path, words: every conversation behind the opening of the first one of its group of 20.

    The first h turns, h = crc32(id) % 4, are those of the conversation with the next lower multiple of 20
    as id, which may have fewer or none at all; the conversation's own turns follow from turn h on.
    ``path`` is the digests one after the other, ``words`` the words of each turn.
    """
    own = materialise(sequences(conversations), "trie-turns")
    opening = own.where(F.col("conv_id") % GROUP == 0).select(
        F.col("conv_id").alias("first_id"), F.slice("turns", 1, 3).alias("opening")
    )
    first = F.col("conv_id") - F.pmod("conv_id", F.lit(GROUP))
    taken = (F.crc32(F.col("conv_id").cast("string")) % 4).cast("int")
    turns = own.withColumn("first_id", first).withColumn("taken", taken).join(opening, "first_id", "left")
    joined = F.when(F.col("opening").isNull(), F.expr("slice(turns, taken + 1, size(turns))")).otherwise(
        F.concat(F.slice("opening", F.lit(1), F.col("taken")), F.expr("slice(turns, taken + 1, size(turns))"))
    )
    turns = turns.select("conv_id", joined.alias("turns"))
    return turns.select(
        "conv_id",
        F.unhex(F.array_join(F.col("turns.digest"), "")).alias("path"),
        F.col("turns.words").alias("words"),
    )


class _Range:
    """The sorted conversations of one range and the nodes of every depth."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, digests: np.ndarray, words: np.ndarray) -> None:
        starts = np.cumsum(lengths) - lengths
        order = self._sorted(ids, lengths, starts, digests)
        self.ids, self.lengths, self.starts = ids[order], lengths[order], starts[order]
        self.digests, self.words, self.rows = digests, words, len(ids)
        self.levels = list(self._levels())

    @staticmethod
    def _matrix(rows: np.ndarray, lengths: np.ndarray, starts: np.ndarray, digests: np.ndarray, block: int) -> np.ndarray:
        """Turns of one block, row by row, padded with zeros: rows x WIDTH x two halves of a digest."""
        at = block * WIDTH + np.arange(WIDTH)
        there = at < lengths[rows, None]
        matrix = np.zeros((len(rows), WIDTH, 2), dtype=np.uint64)
        matrix[there] = digests[(starts[rows, None] + at)[there]]
        return matrix

    def _sorted(self, ids: np.ndarray, lengths: np.ndarray, starts: np.ndarray, digests: np.ndarray) -> np.ndarray:
        """Rows by turns, then ids. Rows that go on after a block trade places within their group by the next."""
        order, slots, label, block = np.arange(len(ids)), np.arange(len(ids)), np.zeros(len(ids), dtype=np.int64), 0
        while len(slots):
            rows = order[slots]
            matrix = self._matrix(rows, lengths, starts, digests, block)
            longer = lengths[rows] > (block + 1) * WIDTH
            columns = [matrix[:, turn, half] for turn in range(WIDTH - 1, -1, -1) for half in (1, 0)]
            place = np.lexsort((ids[rows], longer, *columns, label))
            order[slots] = rows[place]
            changed = (matrix[place][1:] != matrix[place][:-1]).any(axis=(1, 2)) | (np.diff(label[place]) != 0)
            group = np.concatenate([[0], np.cumsum(changed)])
            slots, label, block = slots[longer[place]], group[longer[place]], block + 1
        return order

    def _levels(self) -> Iterator[dict[str, np.ndarray]]:
        """Nodes by depth: first row, members, members that end there, smallest id, words of the turn."""
        rows = np.arange(self.rows)
        yield self._nodes(rows, np.arange(len(rows)) == 0, 0)
        changed, block = np.arange(np.count_nonzero(self.lengths)) == 0, 0
        while len(rows := np.flatnonzero(self.lengths > block * WIDTH)):
            matrix = self._matrix(rows, self.lengths, self.starts, self.digests, block)
            mask = np.ones((len(rows), WIDTH), dtype=bool)
            mask[1:] = (matrix[1:] != matrix[:-1]).any(axis=2)
            # A row starts a node at every depth from the first turn on that differs from the row before.
            mask[:, 0] |= changed
            mask = np.logical_or.accumulate(mask, axis=1)
            for turn in range(WIDTH):
                there = self.lengths[rows] > block * WIDTH + turn
                if there.any():
                    yield self._nodes(rows[there], mask[there, turn], block * WIDTH + turn + 1)
            # Rows in between may have ended, so groups are told apart by their numbers.
            group = np.cumsum(mask[:, -1])[self.lengths[rows] > (block + 1) * WIDTH]
            changed, block = np.diff(group, prepend=-1) != 0, block + 1

    def _nodes(self, rows: np.ndarray, begins: np.ndarray, depth: int) -> dict[str, np.ndarray]:
        at = np.flatnonzero(begins)
        first = rows[at]
        return {
            "first": first,
            "n": np.diff(np.append(at, len(rows))),
            "ends": np.add.reduceat((self.lengths[rows] == depth).astype(np.int64), at),
            "least": np.minimum.reduceat(self.ids[rows], at),
            "words": self.words[self.starts[first] + depth - 1] if depth else np.zeros(1, dtype=np.int64),
        }

    def key(self, row: int) -> list[bytes]:
        """Keys of the nodes on a row's path, from the root down; equal in every range."""
        keys, digests = [b""], self.digests[self.starts[row] : self.starts[row] + self.lengths[row]]
        for digest in digests.astype(">u8"):
            keys.append(hashlib.blake2b(keys[-1] + digest.tobytes(), digest_size=16).digest())
        return keys

    def ended(self, first: int, count: int) -> bytes:
        """The ids of the members that end at a node; they come first among its members, in order."""
        return b",".join(b"%d" % i for i in self.ids[first : first + count].tolist())

    def tables(self, part: int) -> Iterator[pa.RecordBatch]:
        """All nodes, deepest first. ``side`` tells the path: 0 first row, 1 last row, null within the range.

        Sums of a node within the range are complete. A node on a path has only those of its children
        that lie within the range, and comes with the ids that end at it.
        """
        keys = [self.key(0), self.key(self.rows - 1)]
        sums = np.zeros((3, 1), dtype=np.int64)
        for depth in range(len(self.levels) - 1, -1, -1):
            level, above = self.levels[depth], self.levels[max(depth - 1, 0)]
            first, n = level["first"], level["n"]
            if depth == len(self.levels) - 1:
                sums = np.zeros((3, len(first)), dtype=np.int64)
            # Members of a node follow one another, so only these hold the first or the last row.
            opening, closing = first == 0, first + n == self.rows
            inner = ~(opening | closing)
            side = np.where(opening, 0, 1)
            children, leaves, saved = sums
            leaves = np.where(inner & (children == 0), 1, leaves)
            saved = np.where(inner, saved + (n - 1) * level["words"], saved)
            parent = np.searchsorted(above["first"], first, side="right") - 1
            up_opening = above["first"][parent] == 0
            within = ~(up_opening | (above["first"] + above["n"] == self.rows)[parent]) | (depth == 0)
            ends = [self.ended(f, e) for f, e in zip(first.tolist(), level["ends"].tolist())]
            on_path = [None if i else keys[s] for i, s in zip(inner.tolist(), side.tolist())]
            yield pa.RecordBatch.from_pydict(
                {
                    "part": np.full(len(first), part, dtype=np.int64),
                    "side": pa.array(side, mask=inner, type=pa.int32()),
                    "depth": np.full(len(first), depth, dtype=np.int64),
                    "through": pa.array(closing, mask=inner),
                    "key": pa.array([k and k[depth] for k in on_path], pa.binary()),
                    "parent_key": pa.array([k[depth - 1] if k and depth else None for k in on_path], pa.binary()),
                    "parent_side": pa.array(np.where(up_opening, 0, 1), mask=within, type=pa.int32()),
                    "conv_id": level["least"],
                    "parent_conv_id": pa.array(above["least"][parent], mask=~within | (depth == 0)),
                    "n_convs": n,
                    "n_children": children,
                    "n_leaves": leaves,
                    "saved_tokens": saved,
                    "words": level["words"],
                    "ends": pa.array([None if i else e for i, e in zip(inner.tolist(), ends)], pa.binary()),
                    "ends_sha256": pa.array(
                        [hashlib.sha256(e).hexdigest() if i else None for i, e in zip(inner.tolist(), ends)], pa.string()
                    ),
                }
            )
            # What the nodes within the range add to their parents; children of a node are neighbours.
            own, begins = np.where(inner, [np.ones_like(n), leaves, saved], 0), np.flatnonzero(np.diff(parent, prepend=-1))
            sums = np.zeros((3, len(above["first"])), dtype=np.int64)
            sums[:, parent[begins]] = np.add.reduceat(own, begins, axis=1)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of one range of sequences."""
    found = [batch for batch in batches if batch.num_rows]
    if not found:
        return
    table = pa.Table.from_batches(found)
    paths = table["path"].to_pylist()
    yield from _Range(
        table["conv_id"].to_numpy(),
        np.array([len(path) // 16 for path in paths], dtype=np.int64),
        np.frombuffer(b"".join(paths), dtype=">u8").astype(np.uint64).reshape(-1, 2),
        np.concatenate([chunk.flatten().to_numpy(zero_copy_only=False) for chunk in table["words"].chunks]),
    ).tables(TaskContext.get().partitionId())


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash over all parts of a key's ids; parts come in order and are let go of one by one."""
    current, state = None, None

    def closed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"ended_key": pa.array([current], pa.binary()), "ends_sha256": [state.hexdigest()]})

    for batch in batches:
        for key, ends in zip(batch["key"].to_pylist(), batch["ends"].to_pylist()):
            if key != current:
                if state:
                    yield closed()
                current, state = key, hashlib.sha256(ends)
            else:
                state.update(b"," + ends)
    if state:
        yield closed()


def _joined(paths: DataFrame) -> DataFrame:
    """The nodes on the paths of first and last rows, each put together from its ranges.

    What a subtree adds up to follows from running sums over these nodes in the order of their first rows
    and depths: a subtree is a stretch of that order. Nothing but two sums for each range meets in one task.
    """
    merged = paths.groupBy("key").agg(
        F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"), F.first("words").alias("words"),
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("inner_children"),
        F.sum("n_leaves").alias("inner_leaves"), F.sum("saved_tokens").alias("inner_saved"),
        F.min(F.struct("part", "side")).alias("start"), F.max(F.struct("part", "through")).alias("end"),
    )
    merged = materialise(merged, "trie-paths")
    children = merged.groupBy(F.col("parent_key").alias("child_of")).agg(F.count(F.lit(1)).alias("path_children"))
    counted = merged.join(children, F.col("key") == F.col("child_of"), "left").withColumn(
        "n_children", F.col("inner_children") + F.coalesce("path_children", F.lit(0))
    )
    valued = counted.select(
        "key", "depth", "parent_key", "conv_id", "n_convs", "n_children", "end",
        F.col("start.part").alias("part"), F.col("start.side").alias("side"),
        (F.col("inner_leaves") + (F.col("n_children") == 0).cast("long")).alias("leaves"),
        (F.col("inner_saved") + (F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    valued = materialise(valued, "trie-values")

    sides = paths.select("part").distinct().withColumn("side", F.explode(F.array(F.lit(0), F.lit(1))))
    own = valued.groupBy("part", "side").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    along = Window.orderBy("part", "side").rowsBetween(Window.unboundedPreceding, 0)
    running = sides.join(own, ["part", "side"], "left").na.fill(0).select(
        "part", "side",
        F.sum("leaves").over(along).alias("leaves_to"), F.sum("saved").over(along).alias("saved_to"),
        F.col("leaves").alias("leaves_of"), F.col("saved").alias("saved_of"),
    )
    running = materialise(running, "trie-running")
    deeper = Window.partitionBy("part", "side").orderBy("depth").rowsBetween(0, Window.unboundedFollowing)
    # Leaves and savings of this path from the node on, and so far before its range's path ends.
    begun = valued.select(
        "*", F.sum("leaves").over(deeper).alias("leaves_on"), F.sum("saved").over(deeper).alias("saved_on")
    ).join(running.select("part", "side", "leaves_to", "saved_to"), ["part", "side"])
    last = running.select(
        F.col("part").alias("last_part"), F.col("side").alias("last_side"),
        F.col("leaves_to").alias("leaves_end"), F.col("saved_to").alias("saved_end"),
    )
    ends = (F.col("end.part") == F.col("last_part")) & (F.col("end.through").cast("int") == F.col("last_side"))
    names = merged.select(F.col("key").alias("of_key"), F.col("conv_id").alias("parent_conv_id"))
    return begun.join(last, ends).join(names, F.col("parent_key") == F.col("of_key"), "left").select(
        "key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_end") - F.col("leaves_to") + F.col("leaves_on")).alias("n_leaves"),
        (F.col("saved_end") - F.col("saved_to") + F.col("saved_on")).alias("saved_tokens"),
    )


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(conversations: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations (see ``rebuilt``).

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children,
    n_leaves and saved_tokens (over the node's subtree), ends_sha256 (of the ids of members that end there).

    Turns ascend, a null one first; turns that tie, repeated rows too, are ordered by the digest of role and
    text. Null roles and texts are empty. Rows without conversation id belong to no conversation and are
    left out. Conversations without turns left are members of the root. No rows give no nodes, not even
    a root. Texts of any length count as 128 bits and a number of words from the first step on. Other
    columns are ignored.

    Ranges are cut by (sequence, id), so copies of one conversation spread over ranges too. One conversation
    is one row: 24 bytes a turn must fit into a task. Ids that end at one node are hashed in order, as
    that hash demands, but they come as one text for each range and pass in constant memory.
    ``ranges`` is their number, one for 100,000 conversations if null.
    """
    spark = conversations.sparkSession
    whole = materialise(rebuilt(conversations), "trie-rebuilt")
    if ranges is None:
        ranges = max(spark.sparkContext.defaultParallelism, -(-whole.count() // RANGE_ROWS))
    nodes = whole.repartitionByRange(ranges, "path", "conv_id").mapInArrow(_cut, NODES)
    nodes = materialise(nodes, "trie-nodes")

    paths = nodes.where("side IS NOT NULL")
    joined = materialise(_joined(paths.drop("ends")), "trie-joined")
    listed = paths.where("length(ends) > 0").select("key", "part", "ends")
    hashed = listed.repartition("key").sortWithinPartitions("key", "part").mapInArrow(_hashed, "ended_key binary, ends_sha256 string")
    on_paths = joined.join(hashed, F.col("key") == F.col("ended_key"), "left").withColumn(
        "ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))
    )

    inner = nodes.where("side IS NULL")
    hung = paths.select("part", "side", F.col("depth").alias("up_depth"), "key").join(joined.select("key", "conv_id"), "key")
    hung = hung.select(
        F.col("part").alias("up_part"), F.col("side").alias("up_side"), "up_depth", F.col("conv_id").alias("up_conv_id")
    )
    up = (F.col("part") == F.col("up_part")) & (F.col("parent_side") == F.col("up_side")) & (F.col("depth") - 1 == F.col("up_depth"))
    outer = inner.where("parent_side IS NOT NULL").join(hung, up).withColumn("parent_conv_id", F.col("up_conv_id"))
    return (
        inner.where("parent_side IS NULL").select(*RESULT)
        .unionByName(outer.select(*RESULT))
        .unionByName(on_paths.select(*RESULT))
    )


# A node is known by its smallest member and its depth.
SQL = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
),
digests AS (
  SELECT conv_id, turn, left(sha256(strlen(role) || ':' || role || text), 32) AS digest,
         len(regexp_extract_all(text, '{WORDS}')) AS words
  FROM turns
),
own AS (
  SELECT conv_id, list({{'digest': digest, 'words': words}} ORDER BY turn NULLS FIRST, digest) AS turns,
         conv_id - ((conv_id % {GROUP}) + {GROUP}) % {GROUP} AS first_id, {crc32_sql("conv_id")} % 4 AS taken
  FROM digests GROUP BY conv_id
),
whole AS (
  SELECT o.conv_id, coalesce(f.turns, [])[1:o.taken] || o.turns[o.taken + 1:] AS turns
  FROM own o LEFT JOIN own f ON f.conv_id = o.first_id
),
steps AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM whole),
seats AS (
  SELECT conv_id, depth, len(turns) AS size, coalesce(turns[depth].words, 0) AS words,
         min(conv_id) OVER (PARTITION BY list_transform(turns[1:depth], lambda t: t.digest)) AS node
  FROM steps
),
nodes AS (
  SELECT node, depth, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM seats GROUP BY node, depth
),
placed AS (
  SELECT n.*, s.node AS parent FROM nodes n LEFT JOIN seats s ON s.conv_id = n.node AND s.depth = n.depth - 1
),
children AS (SELECT parent AS node, depth - 1 AS depth, count(*) AS n_children FROM placed WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT p.*, coalesce(c.n_children, 0) AS n_children FROM placed p LEFT JOIN children c USING (node, depth)),
sums AS (
  SELECT s.node, s.depth, count(*) FILTER (WHERE c.n_children = 0) AS n_leaves, sum((c.n_convs - 1) * c.words) AS saved_tokens
  FROM counted c JOIN seats s ON s.conv_id = c.node AND s.depth <= c.depth GROUP BY s.node, s.depth
)
SELECT c.node AS conv_id, c.depth, c.parent AS parent_conv_id, c.n_convs, c.n_children, s.n_leaves,
       s.saved_tokens::bigint AS saved_tokens, c.ends_sha256
FROM counted c JOIN sums s USING (node, depth)
"""
