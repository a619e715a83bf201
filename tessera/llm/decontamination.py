"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are windows of ten consecutive words of the benchmark's items. A search looks at blocks of two words: the shift
table tells how far the block's last place in any pattern lies from that pattern's end, so that impossible positions are
skipped, by up to nine words at a time. Where the shift is 0, the block is the end of some patterns; its bucket lists them,
by the hash of the whole window, and those that agree are compared with the text word for word.

Words are hashes, and tables are arrays: some 40 bytes for each word of the benchmark. A search moves along many stretches of
a block of texts at once. Windows of an item with fewer than ten words are as long as the item; the patterns of each length
are searched apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import windows
from tessera.llm.common import slices, small_batches, utf8

#: Bytes of benchmark text that one search holds; a larger benchmark is searched in several passes over the same rows.
PASS_BYTES = 16 << 20
#: Words of a stretch that a search moves along.
STRETCH = 512
#: What parts words: all of ASCII but letters and digits.
PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of texts, with A-Z lowered, and the index of each text's first."""
    starts, ends, first = windows.spans(data, offsets, PARTS)
    return starts, ends, windows.words(data, starts, ends), first


_SPACED = bytes(32 if PARTS[b] else b for b in range(256))


def _split(data: np.ndarray, a: int, b: int) -> list[bytes]:
    return windows.LOWER[data[a:b]].tobytes().translate(_SPACED).split()


def pairs(hashes: np.ndarray, at: np.ndarray, b: int) -> np.ndarray:
    """The hashes of the blocks of ``b`` words that end at the words ``at``."""
    own = hashes[at]
    return windows.mix(own + (hashes[at - 1] * windows.STEP if b == 2 else np.uint64(0)))


def ranged(begin: np.ndarray, size: int) -> np.ndarray:
    return begin[:, None] + np.arange(size)


class Search:
    """Wu-Manber tables of windows of ``m`` words each, which begin at the words ``starts`` of ``hashes``, no two alike."""

    def __init__(self, m: int, hashes: np.ndarray, starts: np.ndarray):
        self.m, self.b = m, min(2, m)
        self.most = m - self.b + 1
        self.bits = max(8, int(4 * len(starts)).bit_length())  # neighbouring windows share their blocks
        self.shift = np.full(1 << self.bits, self.most, np.uint8)
        for j in range(self.b - 1, m):
            np.minimum.at(self.shift, self.cell(pairs(hashes, starts + j, self.b)), m - 1 - j)
        self.order = np.argsort(keys := self.keys(hashes, starts + m - 1), kind="stable").astype(np.int32)
        self.sorted = keys[self.order]

    def cell(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks >> np.uint64(64 - self.bits)).astype(np.int64)

    def keys(self, hashes: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Of windows that end at ``last``: the hash of the last block in the high half, of the whole window in the low one."""
        whole = np.zeros(len(last), np.uint64)
        for j in range(self.m):
            whole = whole * windows.STEP + hashes[last - self.m + 1 + j]
        half = np.uint64(32)
        return pairs(hashes, last, self.b) >> half << half | windows.mix(whole) >> half

    def candidates(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The words at which the block is the end of some window. Texts start at ``first``."""
        sizes = np.maximum(np.diff(first) - self.m + 1, 0)  # places where a window may end
        n = -(-sizes // STRETCH)
        text = np.repeat(np.arange(len(sizes)), n)
        number = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
        at = first[:-1][text] + self.m - 1 + number * STRETCH
        end = np.minimum(at + STRETCH, first[1:][text])
        found = []
        while len(at):
            step = self.shift[self.cell(pairs(hashes, at, self.b))]
            found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            inside = at < end
            at, end = at[inside], end[inside]
        return np.concatenate([np.zeros(0, np.int64), *found])


class Benchmark:
    """The windows of the items, the items of each window, and the searches for them."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        texts = pa.array([text for _, text in items], pa.large_string())
        self.data, offsets = utf8(texts)
        begin, end, self.hashes, first = word_hashes(self.data, offsets)
        self.begin, self.end = begin.astype(np.int32), end.astype(np.int32)  # one search holds PASS_BYTES or one item
        owner = np.array([number[name] for name, _ in items], np.int64)
        sizes = np.diff(first)
        self.searches: list[tuple[Search, np.ndarray, np.ndarray, np.ndarray]] = []
        for m in sorted({min(x, width) for x in sizes.tolist() if x}):
            own = np.flatnonzero(sizes == m if m < width else sizes >= width)
            n = sizes[own] - m + 1
            starts = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            whole = np.zeros(len(starts), np.uint64)
            for j in range(m):
                whole = whole * windows.STEP + self.hashes[starts + j]
            distinct, at, of = np.unique(whole, return_index=True, return_inverse=True)
            of, held = np.divmod(np.unique(of * len(self.names) + np.repeat(owner[own], n)), len(self.names))
            bounds = np.searchsorted(of, np.arange(len(distinct) + 1))
            self.searches.append((Search(m, self.hashes, starts[at]), starts[at].astype(np.int32), held.astype(np.int32), bounds.astype(np.int32)))

    def words(self, start: int, m: int) -> list[bytes]:
        return _split(self.data, self.begin[start], self.end[start + m - 1])

    def occurrences(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set]]:
        """(begin, end) of the words that windows cover, and for each text with any the items they are of."""
        begins, sizes, items = [], [], {}
        for search, own, held, bounds in self.searches:
            last = search.candidates(hashes, first)
            if not len(last):
                continue
            keys = search.keys(hashes, last)
            low, high = np.searchsorted(search.sorted, keys, "left"), np.searchsorted(search.sorted, keys, "right")
            n = high - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            window, last = search.order[at], np.repeat(last, n)
            begin = last - search.m + 1
            same = (self.hashes[ranged(own[window], search.m)] == hashes[ranged(begin, search.m)]).all(1)
            window, begin = window[same], begin[same]
            if not len(begin):
                continue
            # the same words, not only the same hashes of words; each window is looked at once
            found, at = np.unique(window, return_index=True)
            if wrong := [w for w, i in zip(found.tolist(), begin[at].tolist(), strict=True) if self.words(own[w], search.m) != _split(data, starts[i], ends[i + search.m - 1])]:
                right = ~np.isin(window, wrong)
                window, begin = window[right], begin[right]
            text = np.searchsorted(first, begin, "right") - 1
            begins.append(begin)
            sizes.append(np.full(len(begin), search.m))
            for t, w in zip(*(x.tolist() for x in np.divmod(np.unique(text * len(own) + window), len(own))), strict=True):
                items.setdefault(t, set()).update(held[bounds[w] : bounds[w + 1]].tolist())
        if not begins:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), items
        begin = np.concatenate(begins)
        return begin, begin + np.concatenate(sizes), items


def covered(begin: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches of words, as disjoint ones in order, cut where a text ends."""
    edge = np.zeros(first[-1] + 1, np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, end, -1)
    inside = np.cumsum(edge[:-1]) > 0
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = first[(first > 0) & (first < len(inside))]
    opens[edges] |= inside[edges]
    closes[edges - 1] |= inside[edges - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def passes(benchmark: DataFrame, most: int) -> Iterator[list[tuple]]:
    """The items in passes of at most ``most`` bytes of text, fetched a partition at a time; a larger item stands alone."""
    held, size = [], 0
    for item, text in benchmark.select("item_id", "text").dropna().toLocalIterator():
        length = len(text.encode())
        if held and size + length > most:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += length
    yield held


def find_passages(docs: DataFrame, benchmark: DataFrame, width: int = 10, pass_bytes: int = PASS_BYTES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, n_words, spans (array of word spans hit, disjoint), items (array of
    item ids as strings, in order of the strings).

    ``benchmark`` (item_id, text): null ids or texts hold no window. A null or empty text has no words; an item without
    words has no window; an item shorter than ``width`` words is one window. Windows that several items share count for
    each. Repeated rows are searched each; an empty benchmark leaves everything clean; no row in gives no row out.
    Other columns are ignored, whatever they are called. The benchmark is broadcast in passes of ``pass_bytes`` of text, whose
    tables take some seven times that, and each pass is one more map over the same rows, so its size is not bounded.
    """
    small_batches(docs.sparkSession)
    sc = docs.sparkSession.sparkContext
    text = F.coalesce(F.col("text"), F.lit("")).alias("__text")
    rows = docs.select(*keep, text, F.lit(0).cast("bigint").alias("__words"), F.array().cast("array<struct<start:int,end:int>>").alias("__spans"), F.array().cast("array<string>").alias("__items"))
    for held in passes(benchmark, pass_bytes):
        tables = sc.broadcast(Benchmark([(str(item), text) for item, text in held], width))

        def searched(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, "__text"):
                data, offsets = utf8(batch.column("__text"))
                starts, ends, hashes, first = word_hashes(data, offsets)
                own, former = batch.column("__spans"), batch.column("__items")
                spans, items = own.to_pylist(), former.to_pylist()
                begin, end, found = tables.value.occurrences(data, starts, ends, hashes, first)
                if len(begin):
                    before = [(first[k] + x["start"], first[k] + x["end"]) for k in found for x in spans[k]]
                    begin, end = (np.concatenate([x, np.array([y[i] for y in before], np.int64)]) for i, x in enumerate((begin, end)))
                    a, b = covered(begin, end, first)
                    text = np.searchsorted(first, a, "right") - 1
                    bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
                    for k, of in found.items():
                        i, j = bounds[k], bounds[k + 1]
                        spans[k] = [{"start": x, "end": y} for x, y in zip((a[i:j] - first[k]).tolist(), (b[i:j] - first[k]).tolist(), strict=True)]
                        items[k] = sorted({*items[k], *(tables.value.names[i] for i in of)})
                columns = [batch.column(c) for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, batch.column("__text"), pa.array(np.diff(first)), pa.array(spans, own.type), pa.array(items, former.type)], batch.schema.names)

        rows = rows.mapInArrow(searched, rows.schema)
    return rows.select(*keep, F.col("__words").alias("n_words"), F.col("__spans").alias("spans"), F.col("__items").alias("items"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated, from ``find_passages``."""
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    of = found.select(F.col("doc_id").cast("bigint").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"))
    return of.withColumn("contaminated", F.col("n_hit") > 0)
