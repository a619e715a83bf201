import pickle
import random
import re
import time

import brute
import numpy as np
import pyarrow as pa

from tessera.llm import decontamination, queries
from tessera.llm.common import utf8

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, items, width=10):
    wanted = {}
    for item, text in items:
        w = WORD.findall(brute.low(text))
        for i in range(max(1, len(w) - width + 1) if w and item is not None else 0):
            wanted.setdefault(tuple(w[i : i + width]), set()).add(str(item))
    out = []
    for r in rows:
        w = WORD.findall(brute.low(r[1]))
        hit, found = set(), set()
        for n in {len(x) for x in wanted}:
            for i in range(len(w) - n + 1):
                if (own := wanted.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((r[0], len(w), len(hit), len(found), brute.sha(",".join(sorted(found))), bool(hit)))
    return brute.Counter(out)


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def items_for(rows):
    words = [WORD.findall(brute.low(r[1])) for r in rows]
    out = [(i, " ".join(w[3 : 3 + 9 + i % 7])) for i, w in enumerate(words) if len(w) > 30 and i % 3 == 0]
    return [*out, (900, "one"), (10, "ONE two, three"), (901, ""), (902, None), (None, "the cat sat"), (903, "cat sat"), (904, "the cat sat on the mat and then the cat sat"), (905, out[0][1]), (905, "one two")]


def test_against_a_plain_search(spark):
    rows = brute.odd_rows() + brute.sample_rows(80)
    items = items_for(rows)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    want = plain(rows, items)
    assert sum(n for r, n in want.items() if r[5]) > 20
    for most in (32 << 20, 200):  # one pass, and many
        got = decontamination.digests(decontamination.find_passages(brute.documents(spark, rows), benchmark, pass_bytes=most))
        assert brute.bag(got, *COLUMNS) == want


def hashes_of(*texts):
    return decontamination.word_hashes(*utf8(pa.array(texts)))


def test_shifts_skip_and_never_miss(monkeypatch):
    patterns = hashes_of("a b c d c d a b a a a a")[2]
    search = decontamination.Search(4, patterns, np.array([0, 4, 8]))
    starts, ends, hashes, first = hashes_of("a b c d a b x a a a a a y a b c", "", "d", "c d a b")
    for stretch in (1, 2, 3, 512):
        monkeypatch.setattr(decontamination, "STRETCH", stretch)
        assert sorted(set(search.candidates(hashes, first).tolist()) & {3, 5, 10, 11, 20}) == [3, 5, 10, 11, 20]
    block = lambda text: search.shift[search.cell(decontamination.pairs(hashes_of(text)[2], np.array([1]), 2))][0]
    assert search.most == 3 and block("c d") == 0 and block("b c") == 1 and block("q r") == 3


def test_many_windows_with_one_end_and_words_of_all_kinds(spark):
    dice = random.Random(4)
    items = [(i, " ".join([f"w{dice.randrange(50)}" for _ in range(8)] + ["same", "end"])) for i in range(4000)]
    items += [(5000 + i, " ".join(["x"] * (10 + i % 3))) for i in range(9)]
    rows = [(i, " ".join(dice.choice(items)[1] for _ in range(6)), None, None, None, None, None) for i in range(50)]
    rows += [(100, "x " * 500, None, None, None, None, None), (101, "same end " * 4000, None, None, None, None, None), (102, " ".join(f"w{dice.randrange(50)}" for _ in range(9000)), None, None, None, None, None)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    began = time.perf_counter()
    got = decontamination.digests(decontamination.find_passages(brute.documents(spark, rows), benchmark))
    assert brute.bag(got, *COLUMNS) == plain(rows, items)
    assert time.perf_counter() - began < 60


def test_tables_are_a_few_times_the_text():
    dice = random.Random(5)
    items = [(str(i), " ".join("".join(dice.choice("abcdefgh") for _ in range(5)) for _ in range(100))) for i in range(2000)]
    own = decontamination.Benchmark(items, 10)
    assert len(pickle.dumps(own)) < 12 * sum(len(t) for _, t in items)


def test_columns_with_clashing_names(spark):
    rows = brute.odd_rows() + brute.sample_rows(40)
    items = items_for(rows)
    docs = brute.documents(spark, rows)
    for name in ("spans", "items", "n_words", "start", "end", "item_id"):
        docs = docs.withColumn(name, docs["key"])
    got = decontamination.digests(decontamination.find_passages(docs, spark.createDataFrame(items, "item_id bigint, text string")))
    assert brute.bag(got, *COLUMNS) == plain(rows, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    docs = brute.documents(spark, brute.odd_rows())
    assert not any(r["contaminated"] for r in decontamination.digests(decontamination.find_passages(docs, none)).collect())
    some = spark.createDataFrame([(1, "one")], "item_id bigint, text string")
    assert decontamination.digests(decontamination.find_passages(brute.documents(spark, []), some)).collect() == []


def test_query(spark):
    t = brute.pq.read_table(f"{brute.SMALL}/documents.parquet").to_pylist()
    items = brute.pq.read_table(f"{brute.SMALL}/benchmark.parquet").to_pylist()
    want = plain([(r["doc_id"], r["text"]) for r in t], [(r["item_id"], r["text"]) for r in items])
    assert brute.bag(queries.op6_decontamination(spark, brute.SMALL), *COLUMNS) == want
