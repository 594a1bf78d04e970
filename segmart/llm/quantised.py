"""Near duplicates among embeddings: product quantisation, inverted lists, exact cosine.

Equal vectors are one class. Classes are dealt into inverted lists by label and nearest coarse centre and
visit those lists that may hold a neighbour. First only codes meet in a list: residuals of residents in
subspace codes, visitors in bytes. Distances to what is looked up for a code, with the known errors of both
codes as slack, tell who may have a neighbour there. Only those then bring their vectors, and their cosines decide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmart.llm.common import columns_as, materialise
from segmart.llm.components import components

# Components of a vector that share a code.
SUBSPACE = 4
# The list of vectors whose length is not the one that the index was fitted on.
UNFITTED = -1
# Distances that are held at once.
DISTANCES = 2_000_000


@dataclass(frozen=True)
class QuantiseSettings:
    """``cosine`` links. ``reach`` is the part of the linking distance by which a list is looked for.

    Two neighbours lie in different lists only if the step from one to the other crosses the border between
    the two centres, and either looks into the other's list if it is near enough to that border. So a pair
    is lost only if its step across the border is longer than twice the reach. Such a component varies around
    1/sqrt(dimensions) of the distance: 0.2 allows for more than three deviations in 64 dimensions, and 0.5
    loses nothing at all.

    Centres are one for ``list_rows`` classes, at most ``max_cells``, fitted on ``sample_rows`` vectors for
    each, the first by a hash; codes on at most ``code_sample``. Every vector is indexed. Lists of more
    than ``block_rows`` residents, or ``bucket_rows`` visitors, are split into blocks. The blocks are compared in
    rounds, in which ``round_rows`` entries move or ``round_share`` for each class, so that disk follows the classes.
    """

    cosine: float = 0.93
    reach: float = 0.2
    list_rows: int = 128
    max_cells: int = 4096
    sample_rows: int = 32
    code_sample: int = 16_384
    codewords: int = 64
    iterations: int = 6
    block_rows: int = 1024
    bucket_rows: int = 50_000
    round_rows: int = 1_000_000
    round_share: int = 3

    @property
    def distance(self) -> float:
        """Of two unit vectors whose cosine is just enough."""
        return float(np.sqrt(2.0 - 2.0 * self.cosine))


@dataclass(frozen=True)
class Index:
    """Coarse centres (cells x dimensions) and codewords of residuals (subspaces x codewords x SUBSPACE)."""

    centres: np.ndarray
    codebook: np.ndarray
    dimensions: int


def unit_vectors(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Rows x dimensions of the vectors in double precision at length 1. All must have the same length."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds ``node``, 128 bits of a vector's label and components; null where it links with nothing."""
    for batch in batches:
        nodes = []
        vectors = batch["embedding"]
        values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        # Minus zero is zero; a null component has become not a number.
        values = values + 0.0
        ends = np.cumsum([0, *pc.fill_null(pc.list_value_length(vectors), 0).to_pylist()])
        for i, (label, known) in enumerate(zip(batch["label"].to_pylist(), batch["vec_id"].is_valid().to_pylist())):
            own = values[ends[i] : ends[i + 1]]
            good = known and label is not None and len(own) and np.isfinite(own).all() and own.any()
            nodes.append(hashlib.blake2b(repr(label).encode() + b"\0" + own.tobytes(), digest_size=16).digest() if good else None)
        yield pa.RecordBatch.from_pydict(
            {**{name: batch[name] for name in batch.schema.names}, "node": pa.array(nodes, pa.binary())}
        )


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the centre that each point is nearest to; a few points at a time have their distances to all."""
    squares = (centres**2).sum(axis=1)
    size = max(1, DISTANCES // len(centres))
    nearest = [(squares - 2 * points[i : i + size] @ centres.T).argmin(axis=1) for i in range(0, len(points), size)]
    return np.concatenate(nearest)


def _k_means(points: np.ndarray, count: int, rounds: int, seed: int = 0) -> np.ndarray:
    """``count`` centres (fewer if there are not so many points) of a bounded sample."""
    start = np.random.default_rng(seed).permutation(len(points))[:count]
    centres = points[start].copy()
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        order = np.argsort(nearest, kind="stable")
        at = np.flatnonzero(np.diff(nearest[order], prepend=-1))
        sums = np.add.reduceat(points[order], at, axis=0)
        centres[nearest[order][at]] = sums / np.diff(np.append(at, len(order)))[:, None]
    return centres


def fit(classes: DataFrame, settings: QuantiseSettings = QuantiseSettings()) -> Index | None:
    """The index for vectors of the commonest length, from a bounded sample; None without vectors."""
    lengths = classes.groupBy(F.size("embedding").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), "size").first()
    if common is None:
        return None
    cells = int(2 ** np.clip(np.round(np.log2(max(common["n"], 1) / settings.list_rows)), 2, np.log2(settings.max_cells)))
    sample = _first_by_hash(classes.where(F.size("embedding") == common["size"]), common["n"], cells * settings.sample_rows)
    points = np.concatenate([unit_vectors(chunk).astype(np.float32) for chunk in sample.chunks if len(chunk)])
    del sample
    centres = _k_means(points, cells, settings.iterations)
    points = points[: settings.code_sample]
    parts = _parts(points - centres[_nearest(points, centres)])
    codebook = np.stack([_k_means(parts[:, i], settings.codewords, settings.iterations, i) for i in range(parts.shape[1])])
    return Index(centres, codebook, common["size"])


def _first_by_hash(classes: DataFrame, count: int, wanted: int) -> pa.ChunkedArray:
    """The vectors of the ``wanted`` first of ``count`` classes by a hash.

    Hashes are spread evenly, so nearly all rows are known to come later before any is ordered; if too few
    are left, all are ordered.
    """
    ordered = classes.select("embedding", "node", F.xxhash64("node").alias("hash"))
    share = (wanted + 10 * wanted**0.5) / count
    for part in (ordered.where(F.col("hash") < int(share * 2**64) - 2**63), ordered) if share < 1 else (ordered,):
        sample = part.orderBy("hash", "node").limit(wanted).select("embedding").toArrow()["embedding"]
        if len(sample) >= wanted:
            break
    return sample


def _parts(rows: np.ndarray) -> np.ndarray:
    """Rows x subspaces x SUBSPACE, the last subspace filled up with zeros."""
    return np.pad(rows, ((0, 0), (0, -rows.shape[1] % SUBSPACE))).reshape(len(rows), -1, SUBSPACE)


ENTRY = (
    "label {label}, length int, node binary, home int, probes array<int>, code binary, code_error float,"
    " bytes binary, step float, byte_error float"
)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value for each row of a matrix."""
    data = np.ascontiguousarray(rows)
    ends = np.arange(len(data) + 1, dtype=np.int32) * np.int32(data.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _encoded(index: Index, settings: QuantiseSettings) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Every class with its own list, the lists it visits, its own included, and both of its codes."""

    def rows(batch: pa.RecordBatch, home, at, cells, codes, errors, steps, tens, byte_errors) -> pa.RecordBatch:
        ends = np.searchsorted(at, np.arange(batch.num_rows + 1)).astype(np.int32)
        return pa.RecordBatch.from_pydict(
            {
                "label": batch["label"],
                "length": pc.list_value_length(batch["embedding"]).cast(pa.int32()),
                "node": batch["node"],
                "home": home.astype(np.int32),
                "probes": pa.ListArray.from_arrays(ends, cells.astype(np.int32)),
                "code": _binary(codes),
                "code_error": errors.astype(np.float32),
                "bytes": _binary(tens),
                "step": steps.astype(np.float32),
                "byte_error": byte_errors.astype(np.float32),
            }
        )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres = index.centres
        squares = (centres**2).sum(axis=1)
        # Twice the distances between centres, times the distance from a border within which a list is looked for.
        border = -2 * centres @ centres.T
        border += squares
        border += squares[:, None]
        np.sqrt(np.maximum(border, 1e-12, out=border), out=border)
        border *= 2 * settings.reach * settings.distance
        for batch in batches:
            fitted = pc.equal(pc.list_value_length(batch["embedding"]), index.dimensions)
            odd = batch.filter(pc.invert(fitted))
            if odd.num_rows:
                cells, none, zeros = np.full(odd.num_rows, UNFITTED), np.empty((odd.num_rows, 0), np.uint8), np.zeros(odd.num_rows)
                yield rows(odd, cells, np.arange(odd.num_rows), cells, none, zeros, zeros, none, zeros)
            whole = batch.filter(fitted)
            # As many rows as keep their distances to all centres within some megabytes.
            size = max(1, DISTANCES // len(centres))
            for start in range(0, whole.num_rows, size):
                part = whole.slice(start, size)
                unit = unit_vectors(part["embedding"]).astype(np.float32)
                distance = squares - 2 * unit @ centres.T
                home = distance.argmin(axis=1)
                distance -= np.take_along_axis(distance, home[:, None], axis=1)
                near = distance <= border[home]
                near[np.arange(len(unit)), home] = True
                residual = _parts(unit - centres[home])
                codes = np.empty(residual.shape[:2], dtype=np.uint8)
                for i, words in enumerate(index.codebook):
                    codes[:, i] = ((words**2).sum(axis=1) - 2 * residual[:, i] @ words.T).argmin(axis=1)
                quantised = index.codebook[np.arange(codes.shape[1]), codes]
                errors = np.sqrt(((residual - quantised) ** 2).sum(axis=(1, 2)))
                steps = np.abs(unit).max(axis=1) / 127
                tens = np.rint(unit / steps[:, None]).astype(np.int8)
                byte_errors = np.sqrt(((unit - tens * steps[:, None]) ** 2).sum(axis=1))
                yield rows(part, home, *np.nonzero(near), codes, errors, steps, tens, byte_errors)

    return encode


LIST = ["label", "length", "cell"]


def _lists(classes: DataFrame, settings: QuantiseSettings) -> DataFrame:
    """Every list with its residents, its visitors and the blocks that they are split into.

    Residents of a long list are split into blocks and so are its visitors; every block of the one meets
    every block of the other. Where more visit than live, the blocks of visitors are so much larger.
    """
    visits = classes.select("label", "length", "home", F.explode("probes").alias("cell"))
    sizes = visits.groupBy(*LIST).agg(
        F.sum((F.col("home") == F.col("cell")).cast("long")).alias("residents"), F.count(F.lit(1)).alias("visitors")
    )
    blocks = F.greatest(F.ceil(F.col("residents") / settings.block_rows).cast("int"), F.lit(1))
    return sizes.withColumn("resident_blocks", blocks).withColumn(
        "visitor_blocks", F.greatest("resident_blocks", F.ceil(F.col("visitors") / settings.bucket_rows).cast("int"))
    )


# Long lists that are sent to every task; their number grows with the vectors.
SENT_LISTS = 20_000


def _in_blocks(classes: DataFrame, lists: DataFrame) -> DataFrame:
    """One entry for a class in its own list, as resident, and one for each list it visits, with its block there.

    Residents have the code of their residual, visitors that of their bytes.
    """
    places = F.posexplode(F.concat(F.array("home"), "probes")).alias("place", "cell")
    entries = classes.select("*", places).withColumn("resident", F.col("place") == 0)
    mine = lambda own, visiting: F.when(F.col("resident"), own).otherwise(visiting)
    entries = entries.select(
        *LIST, "node", "resident", "home", mine(F.col("probes"), None).alias("probes"),
        mine(F.col("code"), F.col("bytes")).alias("code"), mine(F.col("code_error"), F.col("byte_error")).alias("error"),
        mine(None, F.col("step")).alias("step"),
    )
    long_lists = lists.where("visitor_blocks > 1").select(*[F.col(k).alias(f"of_{k}") for k in LIST], "resident_blocks", "visitor_blocks")
    if long_lists.limit(SENT_LISTS + 1).count() <= SENT_LISTS:
        long_lists = F.broadcast(long_lists)
    same = (F.col("label") == F.col("of_label")) & (F.col("length") == F.col("of_length")) & (F.col("cell") == F.col("of_cell"))
    placed = entries.join(long_lists, same, "left").drop(*[f"of_{k}" for k in LIST])
    kinds = [F.coalesce(F.col(n), F.lit(1)) for n in ("resident_blocks", "visitor_blocks")]
    own = [F.array(F.pmod(F.xxhash64("node"), blocks).cast("int")) for blocks in kinds]
    every = [F.sequence(F.lit(0), blocks - 1) for blocks in kinds]
    placed = placed.withColumn("resident_block", F.explode(F.when(F.col("resident"), own[0]).otherwise(every[0])))
    placed = placed.withColumn("visitor_block", F.explode(F.when(F.col("resident"), every[1]).otherwise(own[1])))
    return placed.drop("resident_blocks", "visitor_blocks")


def _bucketed(entries: DataFrame, buckets: int) -> DataFrame:
    block = F.xxhash64("label", "length", "cell", "resident_block", "visitor_block")
    return entries.withColumn("bucket", F.pmod(block, F.lit(buckets)))


def _blocks(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the residents and of the visitors of every block of a bucket."""
    label = pc.dictionary_encode(table["label"].combine_chunks()).indices.to_numpy()
    names = ("visitor_block", "resident_block", "cell", "length")
    columns = [table[name].to_numpy() for name in names]
    resident = table["resident"].to_numpy()
    order = np.lexsort((resident, *columns, label))
    changed = np.zeros(len(order), dtype=bool)
    for column in (*columns, label):
        changed[1:] |= np.diff(column[order]) != 0
    for rows in np.split(order, np.flatnonzero(changed)):
        visitors = np.count_nonzero(~resident[rows])
        if 0 < visitors < len(rows):
            yield rows[visitors:], rows[:visitors]


def _fixed(column: pa.Array, rows: np.ndarray, kind: type) -> np.ndarray:
    """The bytes of these rows, which have the same number, as a matrix."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset :]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=kind)
    return data[ends[rows][:, None] + np.arange(ends[rows[0] + 1] - ends[rows[0]])]


def _survivors(index: Index, settings: QuantiseSettings) -> Callable[[pa.Table], pa.Table]:
    """Entries that by their codes may have a neighbour in their block.

    The square of the distance between a visitor and what a resident's code stands for, less that of what
    links with both errors as slack, is one product of what is known of either. It is not positive for a neighbour.
    """

    def survive(table: pa.Table) -> pa.Table:
        kept = np.zeros(table.num_rows, dtype=bool)
        cell = table["cell"].to_numpy()
        number = pc.dictionary_encode(table["node"].combine_chunks()).indices.to_numpy()
        code = table["code"].combine_chunks().cast(pa.large_binary())
        error, step = (table[n].to_numpy(zero_copy_only=False).astype(np.float32) for n in ("error", "step"))
        subspaces = np.arange(len(index.codebook))
        for residents, visitors in _blocks(table):
            if cell[residents[0]] == UNFITTED:
                kept[residents] = kept[visitors] = len(residents) + len(visitors) > 2
                continue
            there = index.codebook[subspaces, _fixed(code, residents, np.uint8)].reshape(len(residents), -1)[:, : index.dimensions]
            wide = (settings.distance + 1e-3 + error[residents]).astype(np.float32)
            ones = np.ones((len(residents), 1), dtype=np.float32)
            right = np.hstack([-2 * there, -2 * wide[:, None], ones, ((there**2).sum(axis=1) - wide**2)[:, None]]).T
            order = np.argsort(number[residents])
            size = max(1, min(4096, DISTANCES // 4 // len(residents)))
            for start in range(0, len(visitors), size):
                some = visitors[start : start + size]
                here = _fixed(code, some, np.int8) * step[some][:, None] - index.centres[cell[some[0]]]
                slack = error[some][:, None]
                left = np.hstack([here, slack, (here**2).sum(axis=1, keepdims=True) - slack**2, np.ones_like(slack)])
                near = left @ right <= 0
                # A class is no neighbour of its own.
                own = order[np.minimum(np.searchsorted(number[residents], number[some], sorter=order), len(order) - 1)]
                itself = number[residents][own] == number[some]
                near[np.flatnonzero(itself), own[itself]] = False
                kept[some] |= near.any(axis=1)
                kept[residents] |= near.any(axis=0)
        return table.filter(pa.array(kept)).select(SURVIVOR)

    return survive


SURVIVOR = ["label", "length", "cell", "node", "resident", "home", "probes", "resident_block", "visitor_block", "bucket"]


def _links(settings: QuantiseSettings) -> Callable[[pa.Table], pa.Table]:
    """node, links, root: vectors that an entry is linked with, and a node of the block that it is connected to."""

    def linked(table: pa.Table) -> pa.Table:
        names = table["node"].combine_chunks()
        number = pc.dictionary_encode(names).indices.to_numpy()
        size, home, cell = (table[n].to_numpy() for n in ("size", "home", "cell"))
        out: dict[str, list] = {"node": [], "links": [], "root": []}
        for residents, visitors in _blocks(table):
            there = unit_vectors(table["embedding"].combine_chunks().take(pa.array(residents)))
            here = unit_vectors(table["embedding"].combine_chunks().take(pa.array(visitors)))
            hits = np.empty((len(visitors), len(residents)), dtype=bool)
            for start in range(0, len(visitors), 512):
                cosine = here[start : start + 512] @ there.T
                close = np.abs(cosine - settings.cosine) < 1e-9
                # Products in one fixed order, so that both sides of a pair decide alike.
                for v, r in zip(*np.nonzero(close)):
                    cosine[v, r] = (here[start + v] * there[r]).sum()
                hits[start : start + 512] = cosine >= settings.cosine
            hits &= number[visitors][:, None] != number[residents]
            if not hits.any():
                continue
            ours, theirs = hits @ size[residents], np.zeros(len(residents), dtype=np.int64)
            # A resident that does not visit the visitor's list is not going to find it there.
            probes = table["probes"].combine_chunks().take(pa.array(residents))
            owner = np.repeat(np.arange(len(residents)), pc.list_value_length(probes).to_numpy())
            visits = probes.flatten().to_numpy()
            for other in np.unique(home[visitors]):
                if other != cell[residents[0]]:
                    unaware = np.ones(len(residents), dtype=bool)
                    unaware[owner[visits == other]] = False
                    from_there = home[visitors] == other
                    theirs += np.where(unaware, size[visitors][from_there] @ hits[from_there], 0)
            root_v, root_r = number[visitors].copy(), number[residents].copy()
            while True:
                # A node can be both; its two numbers meet by the larger map of numbers.
                least = np.full(number.max() + 1, number.max() + 1)
                np.minimum.at(least, number[visitors], root_v)
                np.minimum.at(least, number[residents], root_r)
                root_v, root_r = least[number[visitors]], least[number[residents]]
                new_v = np.minimum(root_v, np.where(hits, root_r, len(least)).min(axis=1))
                new_r = np.minimum(root_r, np.where(hits, root_v[:, None], len(least)).min(axis=0))
                if (new_v == root_v).all() and (new_r == root_r).all():
                    break
                root_v, root_r = new_v, new_r
            first = {n: i for i, n in zip(range(table.num_rows - 1, -1, -1), number[::-1].tolist())}
            for rows, links, roots, involved in (
                (visitors, ours, root_v, hits.any(axis=1)),
                (residents, theirs, root_r, hits.any(axis=0)),
            ):
                out["node"].append(rows[involved])
                out["links"].append(links[involved])
                out["root"].append(np.array([first[n] for n in roots[involved].tolist()], dtype=np.int64))
        if not out["node"]:
            return pa.table({"node": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.binary())})
        return pa.table(
            {
                "node": names.take(pa.array(np.concatenate(out["node"]))),
                "links": np.concatenate(out["links"]),
                "root": names.take(pa.array(np.concatenate(out["root"]))),
            }
        )

    return linked


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, Spark deletes the shuffle files of every query that has ended, not only when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _linked(classes: DataFrame, settings: QuantiseSettings, index: Index) -> DataFrame:
    """of_node, component_id, n_links for each class."""
    spark = classes.sparkSession
    encoded = classes.select("label", "node", "embedding")
    encoded = encoded.mapInArrow(_encoded(index, settings), ENTRY.format(label=dict(encoded.dtypes)["label"]))
    encoded = materialise(encoded, "quantised-entries")
    lists = materialise(_lists(encoded, settings), "quantised-lists")
    moved = F.col("residents") * F.col("visitor_blocks") + F.col("visitors") * F.col("resident_blocks")
    entries, residents = (n or 0 for n in lists.agg(F.sum(moved), F.sum("residents")).first())
    rounds = max(1, -(-entries // max(settings.round_rows, settings.round_share * residents)))
    buckets = rounds * max(spark.sparkContext.defaultParallelism, -(-entries // (rounds * settings.bucket_rows)))
    kept = _bucketed(_in_blocks(encoded, lists), buckets)
    schema = {field.name: field.dataType.simpleString() for field in kept.schema.fields}
    survivors = None
    for i in range(rounds):
        found = kept.where(F.pmod("bucket", F.lit(rounds)) == i).groupBy("bucket").applyInArrow(
            _survivors(index, settings), ", ".join(f"{name} {schema[name]}" for name in SURVIVOR)
        )
        found = materialise(found, "quantised-survivors")
        survivors = found if survivors is None else survivors.unionByName(found)
    brought = survivors.join(classes.select("node", "embedding", "size"), "node")
    found = brought.groupBy("bucket").applyInArrow(_links(settings), "node binary, links long, root binary")
    found = materialise(found, "quantised-links")

    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = classes.select("node", "vec_id", "size").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy(F.col("root").alias("of_root")).agg(F.min("vec_id").alias("component_id"))
    result = named.join(least, F.col("root") == F.col("of_root")).join(counts, "node", "left").select(
        F.col("node").alias("of_node"), "component_id",
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
    )
    return materialise(result, "quantised-result")


def near_vectors(
    vectors: DataFrame, settings: QuantiseSettings = QuantiseSettings(), index: Index | None = None
) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors with equal labels are linked if their cosine, in double precision, is at least
    ``settings.cosine``. n_links counts the other vectors linked with this one, copies included;
    component_id is the smallest vec_id that links lead to. A vector that is null, empty, zero or has null or
    non-finite components, and one without label or vec_id, links with nothing and is its own component.
    Vectors of different lengths are not linked; those of another length than the commonest are compared in
    blocks without codes. Rows of one vec_id are rows of their own. An empty table gives no rows. Other
    columns are ignored.

    Copies of a vector are one class before anything is compared. Codes lose no link, as their errors are
    added to the distance; only a list that neither of two vectors looks into does (see ``reach``). Lists of
    any length are split into blocks, and from a block leave one count and one connection for each vector,
    never its pairs. A group of n near vectors that are not equal still costs n * n cosines, in blocks.
    """
    source = columns_as(vectors, vec_id="vec_id", label="label", embedding="embedding")
    kinds = {name: kind for name, kind in source.dtypes}
    keyed = source.mapInArrow(
        _keyed, f"vec_id {kinds['vec_id']}, label {kinds['label']}, embedding {kinds['embedding']}, node binary"
    )
    classes = keyed.where("node IS NOT NULL").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"),
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("size"),
    )
    rows = keyed.select("vec_id", "node")
    with _shuffles_dropped(vectors.sparkSession):
        classes = materialise(classes, "quantised-classes")
        index = index or fit(classes, settings)
        result = None if index is None else _linked(classes, settings, index)
    if result is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    joined = rows.join(result, F.col("node") == F.col("of_node"), "left")
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )
