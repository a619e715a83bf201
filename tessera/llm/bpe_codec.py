"""BPE encoding and decoding by a distinct-word table.

Texts are split into words in blocks of some megabytes. A block sends its distinct words, each once, to the buckets of their
hashes; a bucket holds its part of the corpus's table of distinct words, encodes each word once, and answers every block; and a
block puts the ids where its words stand. Decoding joins ids with the pieces of the vocabulary, whose size is bounded.

Neither texts nor the table are broadcast. A block's texts go on as the numbers of its words, the frequent ones low, byte plane
by byte plane and compressed, which takes a third of the bytes of the texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import checkpointed, id_and_text, release, slices

BLOCK_BYTES, BUCKET_BYTES = 32 << 20, 32 << 20
#: Words whose ids are put in place at once.
PLACED = 1 << 17
LEVEL = 6
#: A block has a row for its texts, with bucket -1, and one for its words in each bucket.
BLOCKS = "block bigint, bucket int, doc_ids array<bigint>, words binary, sizes binary, numbers binary, buckets binary"
ANSWERS = "block bigint, bucket int, sizes binary, ids binary"
CODED = "doc_id bigint, ids array<int>, decoded string"


def _pressed(data: bytes) -> bytes:
    return pa.Codec("zstd", compression_level=LEVEL).compress(data, asbytes=True)


def packed(values: np.ndarray, planes: bool = True) -> bytes:
    """Whole numbers in their least width, compressed, after how many there are and how; ``planes``: byte plane by byte plane,
    which suits numbers whose high bytes are mostly alike, while neighbouring bytes of ids tell of each other.
    """
    top = int(values.max()) if len(values) else 0
    width = max(1, -(-top.bit_length() // 8))
    wide = 4 if width <= 4 else 8
    own = values.astype(f"<u{wide}", copy=False).view(np.uint8).reshape(-1, wide)[:, :width]
    return len(values).to_bytes(8, "little") + bytes([width, planes]) + _pressed(np.ascontiguousarray(own.T if planes else own).tobytes())


def unpacked(cell: bytes) -> np.ndarray:
    """As int32 where that holds them, else int64."""
    n, width, planes = int.from_bytes(cell[:8], "little"), cell[8], cell[9]
    wide = 4 if width <= 3 else 8
    out = np.zeros((n, wide), np.uint8)
    if n:
        own = np.frombuffer(pa.decompress(cell[10:], n * width, "zstd", asbytes=True), np.uint8)
        out[:, :width] = own.reshape(width, n).T if planes else own.reshape(n, width)
    return out.view(f"<i{wide}").reshape(n)


def packed_bytes(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _pressed(data)


def unpacked_bytes(cell: bytes) -> bytes:
    return pa.decompress(cell[8:], int.from_bytes(cell[:8], "little"), "zstd", asbytes=True)


class Splitter:
    """Splits texts into words; a special string in a text is a word of its own."""

    def __init__(self, vocabulary: bpe.Vocabulary):
        self.pattern, self.marks = vocabulary.splitter(), tuple(vocabulary.special)

    def words(self, text: str) -> list[str]:
        if any(mark in text for mark in self.marks):
            parts = self.pattern.split(text)
            return [w for k, part in enumerate(parts) for w in ([part] if k % 2 else bpe.words(part))]
        return bpe.words(text)


class Numbered(dict):
    """Numbers words as they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class Block:
    """The texts of a block as they come: their ids, how many words each has, and the words as numbers."""

    def __init__(self, splitter: Splitter):
        self.splitter, self.table, self.doc_ids, self.sizes, self.numbers, self.bytes = splitter, Numbered(), [], [], [], 0

    def add(self, doc_id: int | None, text: str) -> None:
        words = self.splitter.words(text)
        self.doc_ids.append(doc_id)
        self.sizes.append(len(words))
        self.numbers.append(np.fromiter(map(self.table.__getitem__, words), np.int32, len(words)))
        self.bytes += len(text) + 1

    def rows(self, block: int, buckets: int) -> pa.RecordBatch:
        """The texts with words renumbered by how frequent they are, and the words by bucket in the order of their numbers."""
        flat = np.concatenate([np.zeros(0, np.int32), *self.numbers])
        order = np.argsort(-np.bincount(flat, minlength=len(self.table)), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order))
        flat = rank[flat]
        self.numbers = []
        spelled = [w.encode() for w in self.table]
        of = np.array([crc32(w) % buckets for w in spelled], np.int64)[order]
        words: dict[int, list[bytes]] = {}
        for bucket, place in zip(of.tolist(), order.tolist(), strict=True):
            words.setdefault(bucket, []).append(spelled[place])
        out = [(block, -1, self.doc_ids, None, packed(np.array(self.sizes, np.int64)), packed(flat), packed(of))]
        for bucket, own in sorted(words.items()):
            out.append((block, bucket, None, packed_bytes(b"".join(own)), packed(np.array(list(map(len, own)), np.int64)), None, None))
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), *[pa.binary()] * 4)
        names = [x.split()[0] for x in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)


class Table:
    """What encodes the distinct words of a bucket."""

    def __init__(self, source: str):
        vocabulary = bpe.loaded(source)
        self.special, self.encode = vocabulary.special, vocabulary.encoder()

    def ids(self, word: bytes) -> list[int]:
        special = self.special.get(word.decode())
        return self.encode(word) if special is None else [special]

    def answered(self, rows: pa.Table) -> pa.Table:
        """Each distinct word of a bucket is encoded once; a block gets the ids of its words in their order."""
        table, numbers = Numbered(), []
        for words, sizes in zip(rows.column("words").to_pylist(), rows.column("sizes").to_pylist(), strict=True):
            data, ends = unpacked_bytes(words), np.cumsum(unpacked(sizes), dtype=np.int64).tolist()
            own = [data[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            numbers.append(np.fromiter(map(table.__getitem__, own), np.int64, len(own)))
        coded = list(map(self.ids, table))
        length = np.array(list(map(len, coded)), np.int64)
        flat = np.fromiter(chain.from_iterable(coded), np.int64, int(length.sum()))
        start = np.cumsum(length) - length
        sizes, ids = [], []
        for own in numbers:
            sizes.append(packed(length[own]))
            ids.append(packed(flat[bpe.places(start[own], length[own])], planes=False))
        return pa.Table.from_arrays([rows.column("block"), rows.column("bucket"), pa.array(sizes, pa.binary()), pa.array(ids, pa.binary())], ["block", "bucket", "sizes", "ids"])


class Pieces:
    """The bytes of all ids of a vocabulary in a row."""

    def __init__(self, source: str):
        pieces = bpe.loaded(source).pieces
        own = [pieces.get(i, b"") for i in range(max(pieces) + 1)]
        self.known = np.array([i in pieces for i in range(len(own))])
        self.data, self.length = np.frombuffer(b"".join(own), np.uint8), np.array(list(map(len, own)), np.int64)
        self.start = np.cumsum(self.length) - self.length

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids spell, and the bounds of each id."""
        if len(ids) and not (ids.min() >= 0 and ids.max() < len(self.known) and self.known[ids].all()):
            raise ValueError("an id that the vocabulary does not have")
        length = self.length[ids]
        return self.data[bpe.places(self.start[ids], length)], np.append(0, np.cumsum(length))


def coded_block(texts: pa.Table, answers: pa.Table, pieces: Pieces) -> pa.Table:
    """The ids of a block's texts, by the positions of their words, and what they spell."""
    numbers, of = unpacked(texts.column("numbers")[0].as_py()), unpacked(texts.column("buckets")[0].as_py())
    length, start = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
    flat, at = [np.zeros(0, np.int32)], 0
    by_bucket = np.argsort(of, kind="stable")
    begin = dict(zip(*(x.tolist() for x in np.unique(of[by_bucket], return_index=True)), strict=True))
    for bucket, sizes, ids in zip(*(answers.column(c).to_pylist() for c in ("bucket", "sizes", "ids")), strict=True):
        own = unpacked(sizes).astype(np.int64)
        place = by_bucket[begin[bucket] : begin[bucket] + len(own)]
        length[place], start[place] = own, at + np.cumsum(own) - own
        flat.append(unpacked(ids).astype(np.int32))
        at += len(flat[-1])
    table = np.concatenate(flat)
    often = np.bincount(numbers, minlength=len(of))
    letters = np.append(0, np.cumsum(pieces.length[table]))
    ids = np.empty(int(often @ length), np.int32)
    spelled = np.empty(int(often @ (letters[start + length] - letters[start])), np.uint8)
    words = np.append(0, np.cumsum(unpacked(texts.column("sizes")[0].as_py()), dtype=np.int64))
    id_bounds, bounds = np.zeros(len(words), np.int32), np.zeros(len(words), np.int32)  # of texts
    i = j = 0
    for k in range(0, len(numbers), PLACED):
        own = numbers[k : k + PLACED]
        spread = length[own]
        some = table[bpe.places(start[own], spread)]
        data, ends = pieces.spelled(some)
        up_to = np.append(0, np.cumsum(spread))
        inside = slice(*np.searchsorted(words, (k + 1, k + len(own) + 1)))
        id_bounds[inside] = i + up_to[words[inside] - k]
        bounds[inside] = j + ends[up_to[words[inside] - k]]
        ids[i : i + len(some)], spelled[j : j + len(data)] = some, data
        i, j = i + len(some), j + len(data)
    # texts without words end where the one before does
    id_bounds, bounds = np.maximum.accumulate(id_bounds), np.maximum.accumulate(bounds)
    lists = pa.ListArray.from_arrays(pa.array(id_bounds), pa.array(ids))
    texts_of = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds), pa.py_buffer(spelled))
    doc_ids = texts.column("doc_ids")
    doc_ids = doc_ids.combine_chunks() if isinstance(doc_ids, pa.ChunkedArray) else doc_ids
    whole = pa.Table.from_arrays([doc_ids.flatten(), lists, texts_of], ["doc_id", "ids", "decoded"])
    return pa.Table.from_batches(whole.to_batches(max_chunksize=500), whole.schema)


_TOOLS: dict[tuple, object] = {}


def tools(kind, source: str):
    """The one of its kind in this process."""
    if (key := (kind.__name__, hash(source))) not in _TOOLS:
        for other in [k for k in _TOOLS if k[0] == kind.__name__]:
            del _TOOLS[other]
        _TOOLS[key] = kind(source)
    return _TOOLS[key]


def encode_decode(docs: DataFrame, path: str | None = None, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, ids (array of int), decoded (the text that the ids spell).

    ``path``: a byte-level BPE tokenizer file. Ids are those of the library without begin, end or padding. A null or empty
    text has no ids and decodes to an empty one; a null doc_id stays null; repeated rows are encoded each; columns other
    than doc_id and text are ignored, whatever they are called; no row in gives no row out. Texts are encoded whole.
    """
    source = docs.sparkSession.sparkContext.broadcast(bpe.source_of(path))
    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 1), F.lit(0))).first()[0]
    buckets = max(1, -(-size // bucket_bytes))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter = Splitter(bpe.loaded(source.value))
        block, n, first = Block(splitter), 0, TaskContext.get().partitionId() << 32
        for batch in slices(batches, most=1 << 20):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if block.bytes and block.bytes + len(text) > block_bytes:
                    yield block.rows(first + n, buckets)
                    block, n = Block(splitter), n + 1
                block.add(doc_id, text)
        if block.doc_ids:
            yield block.rows(first + n, buckets)
        release()

    def answered(table: pa.Table) -> pa.Table:
        out = tools(Table, source.value).answered(table)
        release()
        return out

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        out = coded_block(left, right, tools(Pieces, source.value))
        release()
        return out

    blocks = checkpointed(rows.mapInArrow(split, BLOCKS))
    texts = blocks.filter("bucket < 0").select("block", "doc_ids", "sizes", "numbers", "buckets")
    answers = blocks.filter("bucket >= 0").select("block", "bucket", "words", "sizes").groupBy("bucket").applyInArrow(answered, ANSWERS)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(joined, CODED)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of ``encode_decode``."""
    return encode_decode(docs, path).select("doc_id", "ids")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """One row per row of ``encoded`` (doc_id, ids): doc_id, text. Null ids give an empty text; an unknown id is an error."""
    source = encoded.sparkSession.sparkContext.broadcast(bpe.source_of(path))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tools(Pieces, source.value)
        for batch in batches:
            texts = [pieces.spelled(np.array(ids, np.int64))[0].tobytes().decode("utf-8", "replace") for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = encoded.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(decoded, "doc_id bigint, text string")


def digests(coded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
