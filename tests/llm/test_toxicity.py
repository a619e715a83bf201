import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest

from tessera.llm import queries, toxicity


def unit(dice, n):
    v = {dice.randrange(n): dice.random() + 0.01 for _ in range(dice.randrange(1, 6))}
    norm = sum(x * x for x in v.values()) ** 0.5
    return {t: x / norm for t, x in v.items()}


def triples(vectors):
    rows = [(i, t, x) for i, v in enumerate(vectors) for t, x in sorted(v.items())]
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])


@pytest.mark.parametrize("seed, n, block", [(0, 500, 256), (1, 500, 16), (2, 90, 8), (3, 7, 4), (4, 1, 4)])
def test_searches_are_exact(seed, n, block, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", block)
    dice = random.Random(seed)
    vectors = [unit(dice, 25) for _ in range(n)]
    ids = np.arange(n) * 7
    index = toxicity.Index(*triples(vectors), np.zeros(n), ids, 30)
    place = {d: p for p, d in enumerate(index.ids.tolist())}
    queries = [unit(dice, 30) for _ in range(150)]
    skip = np.array([dice.randrange(n) for _ in queries])
    for skips in (None, skip):
        got = index.nearest(*triples(queries), len(queries), skip=skips)
        assert len(got) == len(queries)
        for i, (query, (cosines, places)) in enumerate(zip(queries, got, strict=True)):
            all_of = [(-round(sum(x * v.get(t, 0) for t, x in query.items()), 9), place[d * 7]) for d, v in enumerate(vectors)]
            want = sorted((c, p) for c, p in all_of if c < 0 and (skips is None or p != skips[i]))[: toxicity.NEAREST]
            assert np.allclose(cosines, [-c for c, _ in want], rtol=0, atol=2e-9)
            if min(np.diff(sorted({c for c, _ in all_of})), default=1) > 1e-8:
                assert places.tolist() == [p for _, p in want]


def plain_terms(text):
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    return Counter(words), Counter(("^", w[:n]) for w in words for n in toxicity.STARTS if len(w) > n)


def plain_scores(rows, labels, nearest=toxicity.NEAREST):
    """The score of each row by dictionaries, from the definition."""
    held = lambda d: zlib.crc32(str(d).encode()) % 4 == 2
    texts = {d: t for d, t, *_ in rows}
    labelled = [(d, y) for d, y in sorted(labels) if not held(d)]
    n1 = sum(y for _, y in labelled)
    n0 = len(labelled) - n1
    count = {}
    for d, y in labelled:
        for t in {t for c in plain_terms(texts[d]) for t in c}:
            count.setdefault(t, [0, 0])[y] += 1

    def factor(t):
        a, c = count[t][1], count[t][0]
        return max(0, math.log((a + 0.5) / (n1 + 1)) - math.log((c + 0.5) / (n0 + 1)) - toxicity.ERRORS * math.sqrt(1 / (a + 0.5) + 1 / (c + 0.5)))

    known = {t: toxicity.LEAST + factor(t) for t in count if isinstance(t, str) or factor(t) > 0}
    df = Counter(t for _, text, *_ in rows for t in {t for c in plain_terms(text) for t in c})

    def vector(text):
        tf = {t: n for c in plain_terms(text) for t, n in c.items() if t in known}
        v = {t: (1 + math.log(n)) * known[t] * (math.log((1 + len(rows)) / (1 + df[t])) + 1) for t, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / norm for t, x in v.items()}

    examples = [(d, y, vector(texts[d])) for d, y in labelled]

    def votes(v, skip=None):
        near = sorted(((round(sum(x * e.get(t, 0) for t, x in v.items()), 9), y) for d, y, e in examples if d != skip), reverse=True)
        near = [(c, y) for c, y in near if c > 0]
        tied = len(near) > nearest and near[nearest - 1][0] == near[nearest][0]
        weights = [1 / (1 - c + toxicity.SOFTEN) for c, _ in near[:nearest]]
        return None if not near or tied else sum(w * y for w, (_, y) in zip(weights, near, strict=False)) / sum(weights)

    raw = [(votes(v, d), y) for d, y, v in examples]
    assert all(x is not None for x, _ in raw)
    curve = toxicity.isotonic(np.array([x for x, _ in raw]), np.array([float(y) for _, y in raw]))
    return {d: float(np.interp(x, *curve)) for d, t, *_ in rows if (x := votes(vector(t))) is not None}


def test_scores_against_dictionaries(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rows, labels = planted(160, ties=False)
    rows += [(1000, "\u00c9trange \u00e9tranger GRUMBLEXY aeou", "fr", "s", None, None, None)]
    table = spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.score_texts(brute.documents(spark, rows), table).collect()}
    want = plain_scores(rows, labels)
    assert len(want) > 150
    assert max(abs(got[d] - x) for d, x in want.items()) < 1e-9


def test_every_text_with_a_known_word_has_neighbours(spark):
    got = queries.op2_toxicity(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 1000 and sum(not r["neighbours"] for r in got) <= 3
    assert all(len(r["neighbours"]) == len(r["cosines"]) and list(r["cosines"]) == sorted(r["cosines"], reverse=True) for r in got)


def test_repeated_ids_have_one_text(spark):
    rows, labels = planted(80)
    table = spark.createDataFrame([(d, 1, y) for d, y in labels], "doc_id bigint, quality int, toxic int")
    more = [(d, t[::-1], *rest) for d, t, *rest in rows[:40]]
    scores = [sorted((r["doc_id"], r["score"]) for r in toxicity.score_texts(brute.documents(spark, x), table).collect()) for x in (rows + more, more[::-1] + rows)]
    assert np.allclose([s for _, s in scores[0]], [s for _, s in scores[1]], rtol=0, atol=1e-12)


def test_columns_with_clashing_names(spark):
    rows, labels = planted(40)
    table = spark.createDataFrame([(d, 1, y, 2.0, "x") for d, y in labels], "doc_id bigint, quality int, toxic int, score double, text string")
    docs = brute.documents(spark, rows)
    for name in ("toxic", "score", "neighbours", "cosines", "features", "term", "n"):
        docs = docs.withColumn(name, docs["key"])
    plain = toxicity.score_texts(brute.documents(spark, rows), table).collect()
    assert sorted(map(str, toxicity.score_texts(docs, table).collect())) == sorted(map(str, plain))


def test_calibration_is_monotone():
    dice = np.random.default_rng(2)
    x = np.round(dice.random(300), 1)
    at, level = toxicity.isotonic(x, (dice.random(300) < x).astype(float))
    assert (np.diff(at) >= 0).all() and (np.diff(level) >= 0).all() and level.min() > 0 and level.max() < 1
    assert abs(np.interp(0.8, at, level) - 0.8) < 0.15


RUDE = ("grumblex", "snarvish", "blortung")


def planted(n, toxic_every=4, first=0, ties=True):
    dice = random.Random(9)
    word = lambda: "".join(dice.choice("aeioustrn") for _ in range(dice.randrange(3, 9)))
    rows, labels = [], []
    for i in range(first, first + n):
        words = [word() for _ in range(60)] + ([] if ties else [f"same{dice.randrange(9)}" for _ in range(dice.randrange(9, 40))])
        if i % toxic_every == 0:
            for _ in range(4):
                words[dice.randrange(60)] = dice.choice(RUDE) + dice.choice(("", "a", "est", word()))
        rows.append((i, " ".join(words), "en", "s", None, None, None))
        labels.append((i, int(i % toxic_every == 0)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark):
    rows, labels = planted(600)
    table = spark.createDataFrame([(d, 1, t) for d, t in labels] + [(3, 0, None), (None, 0, 1), (9999, 0, 1)], "doc_id bigint, quality int, toxic int")
    extra = [r for r in brute.odd_rows() if r[0] is None] + [(700, "", None, None, None, None, None), (701, None, None, None, None, None, None)]
    got = toxicity.digests(toxicity.score_texts(brute.documents(spark, rows + extra + rows[:3]), table)).collect()
    assert len(got) == len(rows) + len(extra) + 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    for r in got:
        if r["doc_id"] is not None:
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    held = {r["doc_id"]: r for r in got if r["held_out"] and r["doc_id"] < 600}
    assert len(held) > 100 and all(r["predicted"] == dict(labels)[d] for d, r in held.items())
    assert all(zlib.crc32(str(n).encode()) % 4 != 2 for r in got for n in r["neighbours"])
    assert len({r["score"] for r in got if not r["features"]}) == 1


def test_labels_of_held_out_rows_are_not_used(spark):
    rows, labels = planted(400)
    turned = [(d, 0, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, t in labels]
    docs = brute.documents(spark, rows)
    score = lambda own: Counter((r["doc_id"], r["score"]) for r in toxicity.score_texts(docs, spark.createDataFrame(own, "doc_id bigint, quality int, toxic int")).collect())
    assert score(turned) == score([(d, 0, t) for d, t in labels])


def test_no_labels_and_no_rows(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    got = toxicity.score_texts(brute.documents(spark, brute.odd_rows()), none).collect()
    assert len(got) == len(brute.odd_rows()) and {r["score"] for r in got} == {0.0}
    assert toxicity.score_texts(brute.documents(spark, []), none).collect() == []


@pytest.mark.parametrize("sf, met", [("sf0.01", 0.93), ("sf0.1", 0.97)])
def test_query_on_the_tables(spark, sf, met):
    # at sf0.01 there are 300 labelled examples, 37 of them toxic
    labels = {r["doc_id"]: r["toxic"] for r in brute.pq.read_table(f"/root/testdata/{sf}/labels.parquet").to_pylist()}
    got = {r["doc_id"]: r for r in queries.op2_toxicity(spark, f"/root/testdata/{sf}").collect()}
    held = [(r["predicted"], labels[d]) for d, r in got.items() if r["held_out"] and d in labels]
    assert len(got) == {"sf0.01": 1000, "sf0.1": 10_000}[sf] and sum(p == t for p, t in held) >= met * len(held)


def test_beginnings_share_the_sums_of_a_slice(monkeypatch):
    texts = ["Beginnings of words, été, \U0001f600\U0001f600\U0001f600\U0001f600 and a", "", "beginning again: 日本語の長い言葉"]
    powers, calls = toxicity.windows.powers, []
    monkeypatch.setattr(toxicity.windows, "powers", lambda n: calls.append(n) or powers(n))
    terms = toxicity.Terms(toxicity.pa.array(texts))
    got = [(longer.tolist(), hashes) for longer, hashes in terms.beginnings()]
    assert len(calls) == 2 and len(got) == len(toxicity.STARTS)  # one for the words, and one for all their beginnings
    words = [terms.word(i) for i in terms.at.tolist()]
    for n, (longer, hashes) in zip(toxicity.STARTS, got, strict=True):
        assert longer == [i for i, w in enumerate(words) if len(w) > n]
        own = [words[i][:n].encode() for i in longer]
        ends = np.cumsum(list(map(len, own)))
        data = np.frombuffer(b"".join(own), np.uint8)
        plain = toxicity.windows.words(data, ends - list(map(len, own)), ends, toxicity.windows.AS_IS)
        assert np.array_equal(hashes, toxicity.windows.mix(plain + toxicity._KINDS[n]))
