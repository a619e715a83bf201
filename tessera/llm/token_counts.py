"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as its bytes. The adjacent pair of lowest rank is popped from a heap and merged in a linked list, again and
again; the word's count is its initial symbols minus the merges made. No token ids are made. A process remembers the
counts of a bounded number of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import bpe
from tessera.llm.common import id_and_text, slices

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint"

_COUNTS: dict[int, bpe.Memo] = {}


def counter(source: str):
    """A function from a text to its number of tokens."""
    vocabulary = bpe.loaded(source)
    if (key := id(vocabulary)) not in _COUNTS:
        _COUNTS.clear()
        _COUNTS[key] = bpe.Memo(lambda word: vocabulary.count(word.encode()))
    counts, words, special = _COUNTS[key].__getitem__, bpe.words, vocabulary.splitter()
    marks = tuple(vocabulary.special)

    def count(text: str) -> int:
        if not any(mark in text for mark in marks):
            return sum(map(counts, words(text)))
        parts = special.split(text)
        return len(parts) // 2 + sum(sum(map(counts, words(part))) for part in parts[::2])

    return count


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 512) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit (n_tokens > ``limit``).

    ``path``: a byte-level BPE tokenizer file. Counts are those of the library, which takes a special string inside a text
    as one token. A null or empty text has 0 bytes and 0 tokens; a null doc_id stays null; repeated rows are counted each;
    columns other than doc_id and text are ignored; no row in gives no row out. Texts are counted whole.
    """
    source = docs.sparkSession.sparkContext.broadcast(bpe.source_of(path))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(source.value)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(map(count, texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_and_text(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(counted, SCHEMA).withColumn("over_limit", F.col("n_tokens") > limit)
