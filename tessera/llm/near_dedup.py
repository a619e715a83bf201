"""Near-duplicate groups by min-max hashing of word shingles.

Each of K hash functions is evaluated once a shingle and gives two signature values, its minimum and its maximum over the
document's shingles, so that 2K values cost K evaluations. Each value agrees between two documents with the probability of
their Jaccard similarity. Bands of R values are hashed to keys; documents that share a key are candidates, and a candidate
pair is a link only if the full sets say so. With 32 bands of 4 values, a pair of similarity 0.75 shares no key in 5 of a
million cases; that is the only way to miss a link.

Documents with equal sets are one node from the start. The nodes of a key are first compared with one pivot of the key, and
the links make components. What is left are pairs of one key that are in different components and of which neither is the
pivot. They are compared in cells of a bounded number of nodes, a large key being cut into cells that cover all its pairs:
first by signature values, which rules out most nodes, then by full sets. A cell gives out no pairs but the links that join
components, fewer than it has nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import windows
from tessera.llm.common import checkpointed, id_and_text, slices, utf8

K, ROWS = 64, 4
BANDS = 2 * K // ROWS
#: Signature values of 2 K that a pair must share to be compared in full; one of similarity 0.75 does, but in 6 of a billion cases.
AGREE = 68
#: Nodes of a key in a half cell.
HALF = 512
#: Representatives fetched by a broadcast of their ids; more are fetched by a shuffled join.
BROADCAST_IDS = 500_000
_DICE = np.random.default_rng(7)
_XOR = _DICE.integers(0, 1 << 63, K, dtype=np.uint64)
_TIMES = _DICE.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all k-word shingles, and for each text the index of its first. A text of 1 to k - 1 words has one."""
    starts, ends, first = windows.spans(data, offsets)
    hashes = windows.words(data, starts, ends)
    n_words = np.diff(first)
    text_of = np.repeat(np.arange(len(n_words)), n_words)
    whole = windows.runs(hashes, k)
    inside = text_of[: len(whole)] == text_of[k - 1 :] if len(whole) else np.zeros(0, bool)
    whole, owner = whole[inside], text_of[: len(inside)][inside]
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    alone = [windows.runs(hashes[first[t] : first[t + 1]], int(n_words[t]))[0] for t in short]
    counts = np.bincount(owner, minlength=len(n_words)) + np.bincount(short, minlength=len(n_words))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    if len(short):
        whole = np.insert(whole, np.searchsorted(owner, short), np.array(alone, np.uint64))
    return whole, bounds


def signatures(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text that has shingles its band keys, as int64 of (texts, BANDS), and the low bytes of its 2 K values."""
    at = bounds[:-1][np.diff(bounds) > 0]
    values = np.empty((2 * K, len(at)), np.uint64)
    for i in range(K):
        mixed = (hashes ^ _XOR[i]) * _TIMES[i]
        values[i] = np.minimum.reduceat(mixed, at)
        values[K + i] = np.maximum.reduceat(mixed, at)
    keys = np.empty((len(at), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at), b + 1, np.uint64)
        for row in values[b * ROWS : (b + 1) * ROWS]:
            key = windows.mix(key * windows.STEP + row)
        keys[:, b] = key
    return keys.view(np.int64), np.ascontiguousarray(values.astype(np.uint8).T)


def sets(hashes: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """The distinct shingles of each text, sorted."""
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def mark(own: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _signed(k: int):
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            hashes, bounds = shingles(*utf8(batch.column("text")), k)
            own = sets(hashes, bounds)
            some = np.diff(bounds) > 0
            keys, low = signatures(hashes, bounds) if len(hashes) else (np.zeros((0, BANDS), np.int64), np.zeros((0, 2 * K), np.uint8))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(some, BANDS, 0))]), pa.int32()), pa.array(keys.ravel()))
            marks = pa.array([mark(s) if len(s) else None for s in own], pa.binary())
            each = iter(low)
            lows = pa.array([next(each).tobytes() if x else None for x in some], pa.binary())
            sizes = pa.array([len(s) for s in own], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), sizes, marks, lists, lows], ["doc_id", "text_hash", "n_shingles", "mark", "keys", "low"])

    return signed


def _lows(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 2 * K)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose signatures agree enough."""
    for batch in batches:
        if batch.num_rows:
            keep = (_lows(batch.column("low_a")) == _lows(batch.column("low_b"))).sum(1) >= AGREE
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep))


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Cell by cell, from rows in order of ``cell``."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        cell = table.column("cell").to_numpy()
        edges = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        for a, b in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=False):
            yield table.slice(a, b - a)
        held = table.slice(int(edges[-1]) if len(edges) else 0)
    if held is not None:
        yield held


def _apart(roots: np.ndarray) -> np.ndarray:
    """The rows outside the largest component; every pair of different components has one of them."""
    values, of, n = np.unique(roots, return_inverse=True, return_counts=True)
    return np.flatnonzero(of != np.argmax(n)) if len(values) > 1 else np.zeros(0, np.int64)


def _flagged(percent: int):
    def flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The (key, node) of nodes that may be linked with one of another component in their cell."""
        for table in _cells(batches):
            roots, n = table.column("root").to_numpy(), table.column("n").to_numpy()
            if len(outside := _apart(roots)):
                low, hit = _lows(table.column("low")), np.zeros(len(roots), bool)
                for o in outside:
                    near = (roots != roots[o]) & (np.minimum(n, n[o]) * 100 >= np.maximum(n, n[o]) * percent)
                    near = np.flatnonzero(near)
                    near = near[(low[near] == low[o]).sum(1) >= AGREE]
                    if len(near):
                        hit[near] = hit[o] = True
                if hit.any():
                    yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(x).filter(pa.array(hit)) for x in ("key", "node"))], ["key", "node"])

    return flagged


def _linked(percent: int):
    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links between components in each cell, enough to join all that any links join."""
        for table in _cells(batches):
            roots, nodes = table.column("root").to_numpy(), table.column("node").to_numpy()
            if not len(outside := _apart(roots)):
                continue
            own = table.column("own").combine_chunks()
            n = np.diff(own.offsets.to_numpy())
            values, flat = np.unique(own.values.to_numpy()[own.offsets[0].as_py() : own.offsets[-1].as_py()], return_inverse=True)
            at = np.cumsum(n) - n
            holds, found, group = np.zeros(len(values), bool), [], roots.copy()
            for o in outside:
                mine = flat[at[o] : at[o] + n[o]]
                holds[mine] = True
                common = np.add.reduceat(holds[flat].astype(np.int64), at)
                holds[mine] = False
                for x in np.flatnonzero((common * 100 >= (n + n[o] - common) * percent) & (group != group[o])):
                    if group[x] != group[o]:
                        found.append((int(nodes[o]), int(nodes[x])))
                        group[group == group[x]] = group[o]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    return linked


def _full_sets(k: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=1 << 20):
            hashes, bounds = shingles(*utf8(batch.column("text")), k)
            own = sets(hashes, bounds)
            right = [i for i, (s, m) in enumerate(zip(own, batch.column("mark").to_pylist(), strict=True)) if len(s) and mark(s) == m]
            if right:
                offsets = np.concatenate([[0], np.cumsum([len(own[i]) for i in right])])
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([own[i] for i in right]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(right)), lists], ["node", "own"])

    return full


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): the smallest node that is reachable. By large and small stars."""

    def least(of: DataFrame) -> DataFrame:
        return checkpointed(of.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))

    def print_of(of: DataFrame):
        return of.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    stars = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct())
    former = print_of(stars)
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        large = checkpointed(large)
        lowest = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(lowest, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        stars = checkpointed(small.select("e.u", "e.v").filter("u > v").distinct())
        now = print_of(stars)
        if now == former:
            break
        former = now
    roots = stars.select(F.col("v").alias("node")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))


def in_cells(rows: DataFrame) -> DataFrame:
    """``rows`` (key, node, ...) with ``cell``, repeated so that any two nodes of a key meet in a cell, and sorted by it.

    A key of up to 2 HALF nodes is one cell. A larger one is dealt into parts of about HALF nodes, and each two make a cell.
    """
    counts = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")))  # so that a skewed join with it can be split
    parts = F.when(F.col("m") <= 2 * HALF, F.lit(1)).otherwise(F.ceil(F.col("m") / HALF)).cast("int")
    dealt = rows.join(counts, "key").withColumn("q", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("q")).cast("int"))
    others = F.filter(F.sequence(F.lit(0), F.col("q") - 1), lambda x: (x != F.col("part")) | (F.col("q") == 1))
    met = dealt.withColumn("other", F.explode(others))
    cell = F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other"))
    return met.withColumn("cell", cell).drop("m", "q", "part", "other").repartition("cell").sortWithinPartitions("cell")


def row() -> Column:
    """Tells rows apart by id and text, whether there is an id or not."""
    return F.xxhash64("doc_id", "text_hash")


class _Graph:
    """The nodes, and the candidates among them."""

    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.k, self.percent = k, percent
        self.texts = id_and_text(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
        self.signed = checkpointed(self.texts.mapInArrow(_signed(k), "doc_id bigint, text_hash bigint, n_shingles bigint, mark binary, keys array<bigint>, low binary"))
        nodes = self.signed.filter("n_shingles > 0").groupBy("mark").agg(F.min("doc_id").alias("least"), F.min(row()).alias("row"), F.first(F.struct("keys", "low", "n_shingles")).alias("own"))
        nodes = nodes.select("mark", "least", "row", F.col("own.n_shingles").alias("n"), "own.keys", "own.low")
        self.nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
        keyed = self.nodes.select("node", F.explode("keys").alias("key"))
        shared = checkpointed(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("pivot")).filter("c > 1"))
        self.candidates = checkpointed(keyed.join(shared, "key").filter("node <> pivot"))

    def sets(self, needed: DataFrame) -> DataFrame:
        """(node, own) with the full set of each of the distinct nodes of ``needed``, computed from the text of one of its rows
        again. It is written, so that skewed joins with it can be split.
        """
        needed = checkpointed(needed.select("node").distinct().join(self.nodes.select("node", "mark", "row"), "node"))
        few = needed.count() <= BROADCAST_IDS
        texts = self.texts.withColumn("row", row()).join(F.broadcast(needed) if few else needed, "row").select("node", "mark", "text")
        return checkpointed(texts.mapInArrow(_full_sets(self.k), "node bigint, own array<bigint>").dropDuplicates(["node"]))

    def pivot_links(self) -> DataFrame:
        """The links (a, b) between the nodes of a key and its pivot."""
        pairs = self.candidates.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
        own = self.nodes.select("node", "n", "low")
        for x in ("a", "b"):
            pairs = pairs.join(own.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("low").alias(f"low_{x}")), x)
        possible = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * self.percent
        alike = checkpointed(pairs.filter(possible).select("a", "b", "low_a", "low_b").mapInArrow(_alike, "a bigint, b bigint"))
        sets = self.sets(alike.select(F.explode(F.array("a", "b")).alias("node")))
        for x in ("a", "b"):
            alike = alike.join(sets.select(F.col("node").alias(x), F.col("own").alias(f"own_{x}")), x)
        common = F.size(F.array_intersect("own_a", "own_b"))
        sizes = F.size("own_a") + F.size("own_b")
        return checkpointed(alike.withColumn("i", common).filter(F.col("i") * 100 >= (sizes - F.col("i")) * self.percent).select("a", "b"))

    def solve(self) -> DataFrame:
        """(node, root) of the nodes in groups of two or more."""
        links = self.pivot_links()
        roots = checkpointed(components(links))
        rows = self.candidates.filter("c > 2").select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        rows = checkpointed(rows)
        split = checkpointed(rows.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key"))
        rows = checkpointed(rows.join(split, "key"))
        if rows.isEmpty():
            return roots
        flags = in_cells(rows.join(self.nodes.select("node", "n", "low"), "node")).select("cell", "key", "node", "root", "n", "low")
        flagged = checkpointed(flags.mapInArrow(_flagged(self.percent), "key bigint, node bigint").distinct())
        rows = checkpointed(rows.join(flagged, ["key", "node"]))
        if rows.isEmpty():
            return roots
        full = in_cells(rows.join(self.sets(rows), "node")).select("cell", "node", "root", "own")
        more = full.mapInArrow(_linked(self.percent), "a bigint, b bigint")
        return components(links.unionByName(more))


def near_groups(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept, and text_hash (xxhash64 of the text, null as empty,
    which tells rows with the same doc_id apart).

    Documents are linked if the Jaccard similarity of their sets of ``k``-word shingles is ``percent`` / 100 at least, and
    component_id is the smallest doc_id reachable by links. A text of fewer words is one shingle; a null text, or one
    without words, has none and is linked with nothing. A null doc_id links others, by a near copy as well as by an exact
    one, but is nobody's smallest; its row has the group's component_id, or none, and is kept. Rows with the same doc_id and
    different texts are judged each. Repeated rows get equal results. Of an empty table nothing is returned. Columns other
    than doc_id and text are ignored, whatever they are called.
    """
    graph = _Graph(docs, k, percent)
    roots = graph.solve()
    nodes = graph.nodes.select("node", "mark", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = checkpointed(nodes.groupBy("root").agg(F.min("least").alias("component_id")))  # so that a skewed join with it can be split
    groups = nodes.join(smallest, "root").select("mark", "component_id")
    rows = graph.signed.select("doc_id", "text_hash", "n_shingles", "mark").join(groups, "mark", "left")
    component = F.when(F.col("mark").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash").select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "text_hash")
