import random

import brute
import numpy as np

from tessera.llm import near_dedup, queries

COLUMNS = ("doc_id", "n_shingles", "component_id", "kept")


def test_against_all_pairs(spark):
    rows = brute.odd_rows() + brute.sample_rows()
    got = near_dedup.near_groups(brute.documents(spark, rows))
    assert brute.bag(got, *COLUMNS) == brute.jaccard_components(rows)


def test_a_near_copy_without_an_id_joins_others(spark):
    middle = [f"w{i}" for i in range(60)]
    a, b = ["x", "y", *middle[2:]], [*middle[:-2], "x", "y"]
    rows = [(1, " ".join(a)), (None, " ".join(middle)), (2, " ".join(b)), (3, " ".join(middle[:30])), (None, " ".join(middle[:29] + ["z"]))]
    rows += [(7, " ".join(middle)), (7, "another text with words enough"), (9, "another text with words enough")]
    for own in (rows[:3], rows):
        own = [(*r, None, None, None, None, None) for r in own]
        got = near_dedup.near_groups(brute.documents(spark, own))
        assert brute.bag(got, *COLUMNS) == brute.jaccard_components(own)
    assert {r["component_id"] for r in near_dedup.near_groups(brute.documents(spark, [(*r, None, None, None, None, None) for r in rows[:3]])).collect()} == {1}


def test_columns_with_clashing_names(spark):
    rows = brute.odd_rows()
    docs = brute.documents(spark, rows)
    for name in ("mark", "keys", "low", "n", "least", "row", "root", "kept", "own", "text_hash", "component_id", "pivot", "cell"):
        docs = docs.withColumn(name, docs["key"])
    assert brute.bag(near_dedup.near_groups(docs), *COLUMNS) == brute.jaccard_components(rows)


def test_chains_and_groups_of_near_copies(spark):
    dice = random.Random(3)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(6))
    rows, base = [], [word() for _ in range(120)]
    for i in range(60):  # each differs from the one before by two words, so ends of the chain aren't similar
        base = base[:]
        for _ in range(2):
            base[dice.randrange(len(base))] = word()
        rows.append((500 - i, " ".join(base)))
    star = [word() for _ in range(100)]
    for i in range(60):
        own = star[:]
        for _ in range(2):
            own[dice.randrange(len(own))] = word()
        rows.append((1000 + i, " ".join(own)))
    rows += [(2000 + i, " ".join(star)) for i in range(40)]
    rows = [(*r, None, None, None, None, None) for r in rows]
    want = brute.jaccard_components(rows)
    assert brute.bag(near_dedup.near_groups(brute.documents(spark, rows)), *COLUMNS) == want


def test_a_large_key_is_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "HALF", 4)
    dice = random.Random(6)
    word = lambda: "".join(dice.choice("abcdefgh") for _ in range(6))
    base, rows = [word() for _ in range(60)], []
    for i in range(70):
        own = base[:]
        for _ in range(dice.choice((1, 1, 2, 3, 4))):
            own[dice.randrange(60)] = word()
        rows.append((i, " ".join(own), None, None, None, None, None))
    want = brute.jaccard_components(rows)
    assert 3 < len({r[2] for r in want}) < 60
    assert brute.bag(near_dedup.near_groups(brute.documents(spark, rows)), *COLUMNS) == want


def test_signature_values_agree_as_often_as_sets_overlap():
    dice = np.random.default_rng(1)
    pool = dice.integers(0, 1 << 63, 4000, dtype=np.uint64)
    agreed = []
    for s in range(40):
        part = pool[s * 100 : s * 100 + 100]
        a, b = part[:86], part[14:]  # 72 of 100
        keys, low = near_dedup.signatures(np.concatenate([a, b]), np.array([0, 86, 172]))
        agreed.append(((keys[0] == keys[1]).mean(), (low[0] == low[1]).mean()))
    assert np.allclose(np.mean(agreed, 0), [0.72**near_dedup.ROWS, 0.72], atol=0.03)


def test_components(spark):
    dice = random.Random(2)
    pairs = [(dice.randrange(300), dice.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    got = dict(near_dedup.components(spark.createDataFrame([p for p in pairs if p[0] != p[1]], "a bigint, b bigint")).collect())
    root = {x: x for p in pairs for x in p}
    for _ in range(500):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x in got} and all(r == x for x, r in root.items() if x not in got)


def test_no_text_and_no_rows(spark):
    assert near_dedup.near_groups(brute.documents(spark, [])).collect() == []
    rows = [(1, None, None, None, None, None, None), (2, " ", None, None, None, None, None)]
    assert brute.bag(near_dedup.near_groups(brute.documents(spark, rows)), *COLUMNS) == brute.Counter([(1, 0, 1, True), (2, 0, 2, True)])


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in brute.pq.read_table(f"{brute.SMALL}/documents.parquet").to_pylist()]
    assert brute.bag(queries.op7_near_dedup(spark, brute.SMALL), *COLUMNS) == brute.jaccard_components(rows)
