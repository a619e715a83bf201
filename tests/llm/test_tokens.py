import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, bpe_codec, queries, token_counts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_counts_and_ids_are_the_librarys(spark, library):
    rows = brute.odd_rows() + brute.sample_rows(100)
    docs = brute.documents(spark, rows)
    want = [library.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    counted = token_counts.count_tokens(docs)
    assert brute.bag(counted, "doc_id", "n_bytes", "n_tokens", "over_limit") == brute.Counter((r[0], len((r[1] or "").encode()), len(w), len(w) > 512) for r, w in zip(rows, want, strict=True))
    coded = bpe_codec.digests(bpe_codec.encode_decode(docs))
    expected = brute.Counter((r[0], len(w), brute.sha(",".join(map(str, w))), brute.sha(library.decode(w, skip_special_tokens=False))) for r, w in zip(rows, want, strict=True))
    assert brute.bag(coded, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == expected
    back = bpe_codec.decode(bpe_codec.encode(docs))
    assert brute.bag(back, "doc_id", "text") == brute.Counter((r[0], r[1] or "") for r in rows)


def test_every_code_point_splits_as_in_the_library(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 512):
        text = "".join(f"a{c} 1{c}!{c} " for c in points[i : i + 512])
        assert bpe.words(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)]


def test_few_merges_of_long_and_odd_words(library):
    vocabulary = bpe.Vocabulary.parse(bpe.source_of(None))
    for word in ("a" * 3000, "abab" * 700, " the", "ß" * 99, "\x00", "zzzzzzzzzzq"):
        ids = library.encode(word, add_special_tokens=False).ids
        assert vocabulary.count(word.encode()) == len(ids)
        assert list(vocabulary.encode(word.encode())) == ids


def test_memos_stay_bounded():
    memo = bpe.Memo(len, most=3, longest=4)
    for word in ("a", "bb", "ccc", "dddd", "eeeee", "a", "bb", "ff", "gg"):
        assert memo[word] == len(word)
        assert len(memo) <= 3 and len(memo.former) <= 3 and "eeeee" not in memo


def test_numbers_come_back():
    for values in ([], [0], [255, 256], [3, 1 << 40, 7], list(range(1000))):
        for planes in (True, False):
            assert bpe_codec.unpacked(bpe_codec.packed(np.array(values, np.int64), planes)).tolist() == values
    assert bpe_codec.unpacked_bytes(bpe_codec.packed_bytes(b"")) == b""


@pytest.mark.parametrize("block, bucket", [(1, 1 << 30), (3000, 2000), (1 << 30, 500)])
def test_blocks_and_buckets_of_any_size(spark, library, block, bucket):
    rows = brute.odd_rows() + brute.sample_rows(40) + [(5000 + i, "", None, None, None, None, None) for i in range(9)]
    got = bpe_codec.encode_decode(brute.documents(spark, rows), block_bytes=block, bucket_bytes=bucket).collect()
    want = brute.Counter((r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids), r[1] or "") for r in rows)
    assert brute.Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in got) == want


def test_a_distinct_word_is_encoded_once():
    table, asked = bpe_codec.Table(bpe.source_of(None)), []
    encode = table.encode
    table.encode = lambda word: asked.append(word) or encode(word)
    words = [[b" the", b" cat", "é".encode()], [b" cat", b" the"], [b" the", b"<|endoftext|>"]]
    cells = [(bpe_codec.packed_bytes(b"".join(w)), bpe_codec.packed(np.array(list(map(len, w))))) for w in words]
    rows = pa.table([[1, 2, 3], [0, 0, 0], [c[0] for c in cells], [c[1] for c in cells]], ["block", "bucket", "words", "sizes"])
    out = table.answered(rows)
    assert sorted(asked) == sorted({w for own in words for w in own} - {b"<|endoftext|>"})
    ids = [bpe_codec.unpacked(x).tolist() for x in out.column("ids").to_pylist()]
    assert ids == [[i for w in own for i in table.ids(w)] for own in words]


def test_ids_that_are_not_there_are_errors(spark):
    for ids in ([-1], [999_999_999]):
        with pytest.raises(Exception, match="does not have"):
            bpe_codec.decode(spark.createDataFrame([(1, ids)], "doc_id bigint, ids array<int>")).collect()
    assert bpe_codec.decode(spark.createDataFrame([(1, None)], "doc_id bigint, ids array<int>")).collect()[0]["text"] == ""


def test_columns_with_clashing_names(spark):
    rows = brute.odd_rows()
    docs = brute.documents(spark, rows)
    plain = docs
    for name in ("ids", "block", "bucket", "decoded", "sizes", "n_tokens", "words"):
        docs = docs.withColumn(name, docs["key"])
    for own in (bpe_codec.encode_decode, token_counts.count_tokens):
        assert brute.Counter(map(str, own(docs).collect())) == brute.Counter(map(str, own(plain).collect()))


def test_native_encoder_makes_the_same_merges():
    vocabulary = bpe.Vocabulary.parse(bpe.source_of(None))
    encoder = vocabulary.encoder()
    for piece in vocabulary.pieces.values():
        if piece.decode("utf-8", "replace") not in vocabulary.special:
            assert tuple(encoder(piece)) == vocabulary.encode(piece)


def test_empty_table(spark):
    docs = brute.documents(spark, [])
    assert token_counts.count_tokens(docs).collect() == []
    assert bpe_codec.digests(bpe_codec.encode_decode(docs)).collect() == []


@pytest.mark.parametrize("name", ["op5_token_counts", "op8_bpe_codec"])
def test_queries(spark, name):
    assert queries.QUERIES[name](spark, brute.SMALL).count() == 200
