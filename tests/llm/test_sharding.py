import zlib
from collections import Counter

import brute
import pytest

from tessera.llm import queries, sharding


@pytest.mark.parametrize("shards", [8, 3])
def test_whole_even_gapless_and_in_proportion(spark, shards):
    rows = brute.odd_rows() + brute.sample_rows()
    got = sharding.shard(brute.documents(spark, rows), shards).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], r[3], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(shards)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in sizes.items())
    for source, n in Counter(r[3] for r in rows).items():
        for s in range(shards):
            assert abs(sum(r["source"] == source and r["shard"] == s for r in got) - n / shards) <= 2


def test_seed_decides_and_layout_does_not(spark):
    rows = brute.sample_rows()
    place = lambda df, **k: brute.bag(sharding.shard(df, **k), "doc_id", "shard", "slot")
    docs = brute.documents(spark, rows)
    assert place(docs) == place(docs.repartition(2, "source"), cell_rows=7)
    assert place(docs) != place(docs, seed=5)


def plain_places(rows, offsets, shards):
    """The shard and slot of each row (source, key): by fractional rank, cut evenly."""
    by_source, order = {}, []
    for i, (source, key) in enumerate(rows):
        by_source.setdefault(source, []).append((key, i))
    for source, own in by_source.items():
        order += [((rank + offsets[source]) / len(own), i) for rank, (_, i) in enumerate(sorted(own))]
    n, out, used = len(order), {}, Counter()
    for place, (_, i) in enumerate(sorted(order)):
        out[i] = (place * shards // n, used[place * shards // n])
        used[place * shards // n] += 1
    return out


def test_places_against_plain_ranks(spark):
    F = sharding.F
    rows = [(i, f"text {i}", None, "abc"[(i > 63) + (i > 66)], None, None, None) for i in range(72)]
    docs = brute.documents(spark, rows)
    key = F.xxhash64(F.lit(17), "doc_id", F.crc32("text"), (F.octet_length("text") + 1).cast("bigint"), F.lit(1).cast("bigint"))
    keys = {r[0]: r[1] % (1 << 64) for r in docs.select("doc_id", key).collect()}
    offsets = dict(docs.select("source", sharding.fraction(F.xxhash64(F.lit(17), F.concat(F.lit("="), "source")))).distinct().collect())
    want = plain_places([(r[3], keys[r[0]]) for r in rows], offsets, 8)
    assert {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard(docs, cell_rows=9).collect()} == want


def test_equal_rows_are_dealt_like_others(spark):
    rows = [(None, "same", None, "s", None, None, None)] * 400 + [(5, None, None, None, None, None, None)] * 200 + brute.sample_rows(100)
    got = sharding.shard(brute.documents(spark, rows), cell_rows=20).collect()
    for doc_id, n in ((None, 400), (5, 200)):
        per = Counter(r["shard"] for r in got if r["doc_id"] == doc_id)
        assert len(per) == 8 and max(per.values()) - min(per.values()) <= 8 and sum(per.values()) == n
    assert len({(r["shard"], r["slot"]) for r in got}) == len(rows)


def test_columns_with_clashing_names(spark):
    rows = brute.odd_rows()
    docs = brute.documents(spark, rows)
    for name in ("shard", "slot", "size", "text_crc32", "copies", "rank"):
        docs = docs.withColumn(name, docs["key"])
    assert sorted(map(str, sharding.shard(docs).collect())) == sorted(map(str, sharding.shard(brute.documents(spark, rows)).collect()))


def test_one_source_few_rows_and_none(spark):
    rows = [(i, "t", None, "only", None, None, None) for i in range(5)]
    got = sharding.shard(brute.documents(spark, rows)).collect()
    assert len({r["shard"] for r in got}) == 5 and {r["slot"] for r in got} == {0}
    assert sharding.shard(brute.documents(spark, [])).collect() == []


def test_query(spark):
    got = queries.op10_sharding(spark, brute.SMALL)
    assert dict(got.dtypes)["grown_shard"] == "int" and got.count() == 200
