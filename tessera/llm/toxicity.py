"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

A text's terms are its words, every one that an example holds, and those beginnings of words that tell toxic examples from
others. A term weighs (1 + log tf) * idf, with idf from the counts over all documents, times a factor of the labelled
examples: LEAST for a term that tells nothing, more for one that stands in toxic examples oftener than chance allows. No term
is left out, so every text with a known word has neighbours; the factor only decides which likeness counts most.

The examples' unit vectors lie in an inverted index whose postings are cut into blocks of examples. The largest weight of each
term in each block bounds the cosines there: a search first opens the blocks with the best bounds, and then those alone that
can still reach the k nearest. Searches run for a batch of texts at once.

The votes of the nearest, weighted by distance, are calibrated by isotonic regression on the examples, each judged by the
others. The classifier is fitted on at most EXAMPLES labelled rows, those whose ids hash lowest; everything else covers all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import windows
from tessera.llm.common import checkpointed, id_and_text, release, slices, small_batches, utf8

#: The bound of the fit: labelled rows used.
EXAMPLES = 3072
STARTS = (3, 4, 5, 6, 7, 8)
NEAREST, BLOCK, BATCH = 15, 256, 32
SOFTEN = 0.05  #: added to a distance before its inverse weighs a vote
#: The factor of a term that tells nothing about labels, and the standard errors taken off a log odds ratio.
LEAST, ERRORS = 0.01, 2.5
TOLD = 5  #: words given as evidence
SLICE_BYTES = 1 << 20
#: Bytes that part words: all of ASCII but letters and digits.
PARTS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_KINDS = np.arange(16, dtype=np.uint64) * windows.STEP  #: set beginnings of each length apart from words


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Terms:
    """The words of a slice of texts: where they stand, their hashes, and the distinct ones with their beginnings."""

    def __init__(self, texts: pa.Array):
        self.data, offsets = utf8(pc.utf8_lower(texts))
        self.starts, self.ends, self.first = windows.spans(self.data, offsets, PARTS)
        hashes = windows.words(self.data, self.starts, self.ends, windows.AS_IS)
        self.text_of = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.distinct, self.at, self.of = windows.distinct(hashes)

    def beginnings(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length of STARTS, the distinct words that are longer, and the hashes of their beginnings."""
        if not len(self.distinct):
            return
        begins = (self.data & 0xC0) != 0x80
        letters, before = np.flatnonzero(begins), np.append(0, np.cumsum(begins, dtype=np.int32))
        a, b = self.starts[self.at], self.ends[self.at]
        first, last = before[a], before[b]
        totals = windows.sums(self.data, windows.AS_IS)
        for n in STARTS:
            longer = np.flatnonzero(last - first > n)
            if len(longer):
                yield longer, windows.mix(windows.between(*totals, a[longer], letters[first[longer] + n]) + _KINDS[n])

    def all_hashes(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(text, term) of all words and all their beginnings, each once a text."""
        pairs = np.divmod(np.unique(self.text_of * max(1, len(self.distinct)) + self.of), max(1, len(self.distinct)))
        yield pairs[0], self.distinct[pairs[1]]
        place = np.zeros(len(self.distinct), np.int64)
        for longer, hashes in self.beginnings():
            inside = np.zeros(len(self.distinct), bool)
            inside[longer] = True
            place[longer] = np.arange(len(longer))
            own = inside[pairs[1]]
            yield pairs[0][own], hashes[place[pairs[1][own]]]

    def counts(self, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, how often, the first word that has it) of all terms in ``vocabulary``, sorted hashes, by text."""
        size = len(vocabulary)
        if not size or not len(self.of):
            return (np.zeros(0, np.int64),) * 4
        texts, terms, words = [], [], []
        at = np.minimum(np.searchsorted(vocabulary, self.distinct), size - 1)
        term = np.where(vocabulary[at] == self.distinct, at, -1)
        own = np.flatnonzero(term[self.of] >= 0)
        texts.append(self.text_of[own])
        terms.append(term[self.of[own]])
        words.append(own)
        for longer, hashes in self.beginnings():
            at = np.minimum(np.searchsorted(vocabulary, hashes), size - 1)
            known = vocabulary[at] == hashes
            if known.any():
                term = np.full(len(self.distinct), -1)
                term[longer[known]] = at[known]
                own = np.flatnonzero(term[self.of] >= 0)
                texts.append(self.text_of[own])
                terms.append(term[self.of[own]])
                words.append(own)
        keys, first, n = np.unique(np.concatenate(texts) * size + np.concatenate(terms), return_index=True, return_counts=True)
        return keys // size, keys % size, n, np.concatenate(words)[first]

    def word(self, i: int) -> str:
        return self.data[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")


def expanded(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges in a row, and of which range each is."""
    sizes = end - begin
    of = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(of)) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes), of


class Index:
    """Unit vectors of labelled examples, for exact searches of the nearest by cosine.

    ``vectors`` are (example, term, weight), sorted by example. Postings of terms that many examples hold are rows of a
    matrix, ``common``; those of the others lie in segments, one for each term and block that has any. ``most`` and
    ``segment_most`` have the largest weight of a term in a block.
    """

    def __init__(self, example: np.ndarray, term: np.ndarray, weight: np.ndarray, labels: np.ndarray, ids: np.ndarray, size: int):
        n = len(ids)
        # examples with the same weightiest term stand together, so that bounds of blocks tell them apart
        heaviest = np.zeros(n, np.int64)
        order = np.lexsort((term, weight, example))
        last = np.flatnonzero(np.append(example[order][1:] != example[order][:-1], True)) if len(example) else np.zeros(0, int)
        heaviest[example[order][last]] = term[order][last]
        place = np.empty(n, np.int64)
        ranked = np.lexsort((ids, heaviest))
        place[ranked] = np.arange(n)
        self.labels, self.ids, self.n, self.block = labels[ranked].astype(float), ids[ranked], n, BLOCK
        self.blocks = -(-n // BLOCK)
        by_term = np.lexsort((place[example], term))
        self.own = (place[example], term, weight)  # for the fit alone
        example, term, weight = place[example][by_term], term[by_term], weight[by_term]
        held = np.bincount(term, minlength=size)
        dense = np.flatnonzero(held >= max(n / 8, 2))
        self.row = np.full(size, -1, np.int32)
        self.row[dense] = np.arange(len(dense))
        wide = self.row[term] >= 0
        self.common = np.zeros((len(dense), self.blocks * BLOCK))
        self.common[self.row[term[wide]], example[wide]] = weight[wide]
        self.most = self.common.reshape(len(dense), self.blocks, BLOCK).max(2) if n else np.zeros((0, 0))
        example, term, weight = example[~wide], term[~wide], weight[~wide]
        segment = term * max(1, self.blocks) + example // BLOCK
        begin = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(segment) else np.zeros(0, np.int64)
        self.begin = np.append(begin, len(segment))
        self.segment_block = (segment[begin] % max(1, self.blocks)).astype(np.int32)
        self.segments = np.searchsorted(segment[begin] // max(1, self.blocks), np.arange(size + 1))
        self.segment_most = np.maximum.reduceat(weight, begin) if len(begin) else np.zeros(0)
        self.example, self.weight = example, weight

    def _batch(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int, skip: np.ndarray | None) -> list[tuple[np.ndarray, np.ndarray]]:
        blocks, size = self.blocks, self.block
        wide = self.row[term] >= 0
        dense = np.zeros((n, len(self.common)))
        dense[text[wide], self.row[term[wide]]] = weight[wide]
        text, term, weight = text[~wide], term[~wide], weight[~wide]
        segment, of = expanded(self.segments[term], self.segments[term + 1])
        text, weight, block = text[of], weight[of], self.segment_block[segment]
        bounds = dense @ self.most
        place = text * blocks + block
        bounds += np.bincount(place, weight * self.segment_most[segment], n * blocks).reshape(n, blocks)
        cosines = np.zeros((n, blocks * size))

        def opened(chosen: np.ndarray) -> None:
            """Adds the cosines of the texts with the blocks that are ``chosen`` for them."""
            asked = np.flatnonzero(chosen.ravel()[place])
            s = segment[asked]
            begin = self.begin[s]
            sizes = self.begin[s + 1] - begin
            at = np.arange(sizes.sum()) + np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
            cells = np.repeat(text[asked] * (blocks * size), sizes) + self.example[at]
            found = np.bincount(cells, np.repeat(weight[asked], sizes) * self.weight[at], cosines.size).reshape(cosines.shape)
            np.add(cosines, found, out=cosines)
            for b in np.flatnonzero(chosen.any(0)):
                rows = np.flatnonzero(chosen[:, b])
                cosines[rows, b * size : (b + 1) * size] += dense[rows] @ self.common[:, b * size : (b + 1) * size]

        best = np.zeros((n, blocks), bool)
        best[np.arange(n), np.argmax(bounds, 1)] = True
        opened(best)
        if blocks > 1:
            if skip is not None:
                cosines[np.arange(n), skip] = 0
            enough = max(0, blocks * size - k)
            least = np.partition(cosines, enough, axis=1)[:, enough]
            opened((bounds > 0) & (bounds >= least[:, None] - 1e-9) & ~best)
        if skip is not None:
            cosines[np.arange(n), skip] = 0
        cosines = np.round(cosines, 9)
        enough = max(0, cosines.shape[1] - k)
        least = np.partition(cosines, enough, axis=1)[:, enough]
        out = []
        for row, low in zip(cosines, least, strict=True):
            near = np.flatnonzero((row >= low) & (row > 0))
            near = near[np.lexsort((near, -row[near]))][:k]
            out.append((row[near], near))
        return out

    def nearest(self, text: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, k: int = NEAREST, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``n`` texts, whose unit vectors are (text, term, weight) sorted by text, the cosines and places of the k
        nearest with a positive cosine; of equal ones, the first places. ``skip`` has a place to leave out for each text.
        """
        out = []
        for a in range(0, n, BATCH):
            b = min(n, a + BATCH)
            i, j = np.searchsorted(text, (a, b))
            out += self._batch(text[i:j] - a, term[i:j], weight[i:j], b - a, k, skip[a:b] if skip is not None else None)
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the increasing step function nearest to y over x, each level smoothed towards the mean."""
    order = np.argsort(x, kind="stable")
    mean, levels = y.mean(), []
    for a, b in zip(x[order], y[order], strict=True):
        levels.append([a, a, b, 1])
        while len(levels) > 1 and (levels[-2][2] * levels[-1][3] >= levels[-1][2] * levels[-2][3] or levels[-2][1] == levels[-1][0]):
            low = levels.pop()
            levels[-1] = [levels[-1][0], low[1], levels[-1][2] + low[2], levels[-1][3] + low[3]]
    knots = [(at, (s + mean) / (n + 1)) for a, b, s, n in levels for at in ((a, b) if b > a else (a,))]
    return np.array([k[0] for k in knots]), np.maximum.accumulate([k[1] for k in knots])


@dataclass
class Classifier:
    """``vocabulary`` has the sorted hashes of the terms, and ``weights`` idf times factor of each."""

    vocabulary: np.ndarray
    weights: np.ndarray
    empty: float  #: the share of toxic ones among the examples
    index: Index | None = None
    curve: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.array([0.0, 1.0]), np.array([0.0, 1.0])))

    def unit(self, text: np.ndarray, term: np.ndarray, n: np.ndarray, texts: int) -> np.ndarray:
        weight = (1 + np.log(n)) * self.weights[term]
        norm = np.sqrt(np.bincount(text, weight * weight, texts))
        return weight / np.maximum(norm, 1e-300)[text]

    def votes(self, cosines: np.ndarray, places: np.ndarray) -> float:
        weights = 1 / (1 - cosines + SOFTEN)
        return float((weights * self.index.labels[places]).sum() / weights.sum())

    def score(self, terms: Terms, texts: int) -> Iterator[tuple[float, np.ndarray, np.ndarray, list[str]]]:
        """For each text the probability of label 1, the ids and cosines of the nearest examples, and its weightiest words."""
        text, term, n, word = terms.counts(self.vocabulary)
        weight = self.unit(text, term, n, texts)
        found = self.index.nearest(text, term, weight, texts) if self.index else [(np.zeros(0), np.zeros(0, int))] * texts
        bounds = np.searchsorted(text, np.arange(texts + 1))
        for (cosines, places), a, b in zip(found, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if not len(places):
                yield self.empty, np.zeros(0, np.int64), cosines, []
                continue
            top = a + np.argsort(-weight[a:b], kind="stable")[: 2 * TOLD]
            told = list(dict.fromkeys(terms.word(word[i]) for i in top.tolist()))[:TOLD]
            yield float(np.interp(self.votes(cosines, places), *self.curve)), self.index.ids[places], cosines, told

    def calibrate(self) -> None:
        """Each example is judged by the others."""
        example, term, weight = self.index.own
        order = np.argsort(example, kind="stable")
        found = self.index.nearest(example[order], term[order], weight[order], self.index.n, skip=np.arange(self.index.n))
        raw = [(self.votes(c, p), y) for (c, p), y in zip(found, self.index.labels, strict=True) if len(p)]
        if raw:
            self.curve = isotonic(*map(np.array, zip(*raw, strict=True)))
        else:
            self.curve = (np.array([0.0, 1.0]), np.array([self.empty, max(self.empty, 0.5)]))
        self.index.own = None


def factors(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """LEAST, and more by what a term's log odds of toxic examples exceed chance: ERRORS standard errors are taken off."""
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((other + 0.5) / (n_other + 1))
    return LEAST + np.maximum(odds - ERRORS * np.sqrt(1 / (toxic + 0.5) + 1 / (other + 0.5)), 0)


def _start_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each beginning of words in a slice of examples, how many toxic and how many other ones hold it."""
    for batch in slices(batches, most=SLICE_BYTES):
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False)
        terms = Terms(batch.column("text"))
        for text, hashes in list(terms.all_hashes())[1:]:
            own, of = np.unique(hashes, return_inverse=True)
            once = np.unique(of * batch.num_rows + text)  # two words of a text may share a beginning
            of, label = once // batch.num_rows, toxic[once % batch.num_rows]
            counts = [pa.array(np.bincount(of, label == x, len(own)).astype(np.int64)) for x in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), *counts], ["term", "other", "toxic"])


def _words_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words of each example, as hashes."""
    for batch in slices(batches, most=SLICE_BYTES):
        text, hashes = next(Terms(batch.column("text")).all_hashes())
        bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
        own = pa.array([hashes[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), own], ["toxic", "words"])


def examples_of(texts: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(doc_id, toxic, text) of at most ``most`` labelled documents that are not held out. A toxic label outweighs another,
    and of several texts of an id the least is taken.
    """
    own = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    own = own.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.when(F.col("toxic") > 0, 1).otherwise(0)).alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # at most EXAMPLES pairs of numbers are broadcast
    return checkpointed(texts.join(F.broadcast(checkpointed(chosen)), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")))


def vocabulary_of(examples: DataFrame, n_toxic: int, n_other: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of all words of the examples and of the beginnings that tell toxic ones apart, and their factors."""
    rows = examples.mapInArrow(_words_held, "toxic int, words binary").toArrow()
    words = [np.frombuffer(x, np.uint64) for x in rows.column("words").to_pylist()]
    flat, label = np.concatenate([np.zeros(0, np.uint64), *words]), np.repeat(rows.column("toxic").to_numpy(), list(map(len, words)))
    own, of = np.unique(flat, return_inverse=True)
    toxic = np.bincount(of, label, len(own))
    told = factors(toxic, np.bincount(of, minlength=len(own)) - toxic, n_toxic, n_other)
    starts = examples.mapInArrow(_start_counts, "term bigint, other bigint, toxic bigint").groupBy("term").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic"))
    odds = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("other") + 0.5) / (n_other + 1))
    strong = starts.filter(odds > ERRORS * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("other") + 0.5))).toArrow()
    more, toxic, other = (strong.column(c).to_numpy() for c in ("term", "toxic", "other"))
    vocabulary, at = np.unique(np.concatenate([own, more.astype(np.int64).view(np.uint64)]), return_index=True)
    return vocabulary, np.concatenate([told, factors(toxic, other, n_toxic, n_other)])[at]


def fit(texts: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Classifier:
    sc = texts.sparkSession.sparkContext
    examples = examples_of(texts, labels, most)
    by_label = dict(examples.groupBy("toxic").count().collect())
    n_toxic, n_other = by_label.get(1, 0), by_label.get(0, 0)
    if not n_toxic + n_other:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    vocabulary, told = vocabulary_of(examples, n_toxic, n_other)
    known = sc.broadcast(vocabulary)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """In how many of a task's texts each term stands, and in the last row how many texts there are."""
        totals, n = np.zeros(len(known.value), np.int64), 0
        for batch in slices(batches, most=SLICE_BYTES):
            totals += np.bincount(Terms(batch.column("text")).counts(known.value)[1], minlength=len(totals))
            n += batch.num_rows
        some = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(totals[some], n))], ["term", "n"])

    counted = texts.select("text").mapInArrow(found, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(vocabulary) + 1)
    df[counted.column("term").to_numpy()] = counted.column("n").to_numpy()  # the number of texts lands in the last place
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            text, term, n, _ = Terms(batch.column("text")).counts(known.value)
            bounds = np.searchsorted(text, np.arange(batch.num_rows + 1))
            cells = [pa.array([x[a:b].astype(np.int32).tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()) for x in (term, n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *cells], ["doc_id", "toxic", "terms", "n"])

    rows = examples.mapInArrow(held, "doc_id bigint, toxic int, terms binary, n binary").orderBy("doc_id").toArrow()
    terms, counts = ([np.frombuffer(x, np.int32) for x in rows.column(c).to_pylist()] for c in ("terms", "n"))
    example = np.repeat(np.arange(len(terms)), list(map(len, terms)))
    term = np.concatenate(terms).astype(np.int64)
    model = Classifier(vocabulary, idf * told, n_toxic / (n_toxic + n_other))
    weight = model.unit(example, term, np.concatenate(counts), len(terms))
    model.index = Index(example, term, weight, rows.column("toxic").to_numpy(), rows.column("doc_id").to_numpy(), len(vocabulary))
    model.calibrate()
    release()
    return model


def score_texts(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, score (0 to 1, higher: label 1 likelier), neighbours (doc_ids of the
    nearest examples, the nearest first), cosines (theirs) and features (the weightiest words of the text, at most TOLD).

    ``labels`` (doc_id, toxic): rows whose crc32 of doc_id as text leaves 2 modulo 4 are not learnt from, nor are ones with a
    null; of several labels of a document the largest counts, of several texts of an id the least, and labels without a
    document are left out. A text without any word that an example holds, an empty or null one too, has the share of toxic
    examples, and no neighbours. With no labels at all every score is 0. Equal texts have equal scores; repeated rows are
    scored each; ties of distance go to the same examples everywhere. Of an empty table nothing is returned; other columns
    are ignored, whatever they are called. Texts are read whole.
    """
    small_batches(docs.sparkSession)
    texts = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    model = docs.sparkSession.sparkContext.broadcast(fit(texts, labels, most))
    rows = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("__text"))
    lists = (F.array().cast("array<bigint>").alias("__near"), F.array().cast("array<double>").alias("__cosines"), F.array().cast("array<string>").alias("__features"))
    out = rows.select(*keep, F.lit(0.0).alias("__score"), *lists).schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "__text", SLICE_BYTES):
            found = model.value.score(Terms(batch.column("__text")), batch.num_rows)
            scores, near, cosines, told = zip(*found, strict=True)
            columns = [pa.array(scores, pa.float64()), pa.array(near, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64())), pa.array(told, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, "__score", "__near", "__cosines", "__features"])

    return rows.mapInArrow(scored, out).withColumnsRenamed({"__score": "score", "__near": "neighbours", "__cosines": "cosines", "__features": "features"})


def digests(scored: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from 0.3), from ``score_texts``, with its evidence."""
    doc_id = F.col("doc_id").cast("bigint")
    return scored.select(doc_id.alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "neighbours", "cosines", "features")
