import textwrap
from pathlib import Path

import brute
import duckdb
import pytest

from tessera.llm import licenses, queries

BODIES = {i: body for i, _, body in licenses.KNOWN}
NAMES = {"Artistic-1.0-Perl": "Artistic", "BSD-3-Clause": "BSD", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-3.0": "LGPL-3"}


def looked_up(spark, texts, own=None):
    docs = brute.documents(spark, [(d, t, None, None, None, None, None) for d, t in texts])
    return brute.bag(licenses.find_licenses(docs, own), "doc_id", "license_id", "stated")


def test_forms_match_whatever_case_lines_and_spelling(spark):
    mit = BODIES["MIT"]
    other = "MIT License\n\nCopyright (c) 2019 Ann Example\n\n" + mit.replace("sublicense", "SUBLICENCE").replace('"', "''").replace("\n\n", "\n \n")
    rows = [(1, mit), (2, other), (3, mit + " more"), (4, "licensed UNDER the Apache Licence, version 2.0"), (5, None), (6, "Copyright 2020 me"), (7, ""), (None, mit)]
    docs = brute.documents(spark, [(*r, None, None, None, None, None) for r in rows])
    got = brute.bag(licenses.find_licenses(docs), "doc_id", "license_id")
    assert got == brute.Counter([(1, "MIT"), (2, "MIT"), (3, None), (4, "Apache-2.0-notice"), (5, None), (6, None), (7, None), (None, "MIT")])
    assert licenses.find_licenses(brute.documents(spark, [])).collect() == []


def test_each_text_wrapped_or_not_and_with_a_notice(spark):
    texts, want = [], []
    for width in (None, 40, 72, 100):
        for own, text in licenses.known_texts():
            paragraphs = [textwrap.fill(p, width) if width else p for p in text.split("\n\n")]
            for notice in ([], ["Copyright (c) 2020, Ann Example\nAll rights reserved."], ["(c) Ann", "Copyright <YEAR> <OWNER>"]):
                texts.append((len(texts), "\n\n".join([*notice, *paragraphs])))
                want.append(own)
    docs = brute.documents(spark, [(*r, None, None, None, None, None) for r in texts])
    got = {r["doc_id"]: r["license_id"] for r in licenses.find_licenses(docs).collect()}
    assert [got[d] for d, _ in texts] == want


def test_long_texts_by_their_digests(spark):
    folder = Path("/usr/share/common-licenses")
    found = [(i, folder / NAMES.get(i, i)) for i, _ in licenses.DIGESTS if (folder / NAMES.get(i, i)).exists()]
    if not found:
        pytest.skip("no such texts on this machine")
    docs = brute.documents(spark, [(d, path.read_text(), None, None, None, None, None) for d, (_, path) in enumerate(found)])
    got = {r["doc_id"]: r["license_id"] for r in licenses.find_licenses(docs).collect()}
    assert [got[d] for d in range(len(found))] == [i for i, _ in found]


def test_the_plain_form_is_the_same(spark):
    texts = [t for _, t in [*licenses.known_texts(), *licenses.notices()]] + [r[1] or "" for r in brute.odd_rows()] + ["licence licence licence", "per cent per cent centre", "copyright notice and this\ncopyright 2020 x\n© y"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in docs.coalesce(1).select(licenses.canonical(docs["text"])).collect()] == list(map(licenses.plain_canonical, texts))


def test_given_licenses_and_ties(spark):
    own = spark.createDataFrame([("b", "Some Terms."), ("a", "some terms"), ("c", "  "), ("d", None)], "license_id string, text string")
    docs = brute.documents(spark, brute.odd_rows() + [(50, "SOME, terms", None, None, None, None, None)])
    got = licenses.find_licenses(docs, own)
    assert got.count() == len(brute.odd_rows()) + 1
    assert [tuple(r) for r in got.filter("license_id is not null").select("doc_id", "license_id").collect()] == [(50, "a")]


def test_sql(spark):
    rows = [(i, t) for i, t in enumerate([None, "", "Copyright\nx", "é €\U0001f600 a", "per cent licence centre", "licence licence licence", *[t for _, t in licenses.known_texts()], *[f"prose\n{t}\n\nprose" for _, t in licenses.notices()]])]
    rows += [(r[0], r[1]) for r in brute.sample_rows()]
    con = duckdb.connect()
    import pandas as pd

    frame = pd.DataFrame(rows, columns=["doc_id", "text"])  # noqa: F841
    con.execute("create table documents as select * from frame")
    docs = brute.documents(spark, [(*r, None, None, None, None, None) for r in rows])
    assert brute.bag(licenses.find_licenses(docs), "doc_id", "digest", "license_id", "stated") == brute.Counter(con.execute(licenses.oracle_sql()).fetchall())


def test_parts_of_texts(spark):
    bare = BODIES["MIT"]
    texts = [
        (1, "Prose before.\nReleased under the MIT Licence.\nprose after"),
        (2, "text\n\n" + bare.replace(" of ", "\nof ") + "\n\nmore text"),
        (3, "no licence here\n\nMIT License"),
        (4, "// SPDX-License-Identifier: Apache-2.0\ncode\nLicensed under CC BY-NC 4.0."),
        (5, None), (6, ""), (None, "x\nLicensed under CC BY-NC 4.0."), (None, "x\nLicensed under CC BY-NC 4.0."),
        (7, "Licensed under CC BY-NC 4.0."), (7, "nothing"),
    ]
    by, mit, apache = "CC-BY-NC-4.0-notice", "MIT", "Apache-2.0-notice"
    want = [(1, None, "MIT-notice"), (2, None, mit), (3, None, ""), (4, None, f"{apache},{by}"), (5, None, ""), (6, None, ""), (None, None, by), (None, None, by), (7, by, by), (7, None, "")]
    assert looked_up(spark, texts) == brute.Counter(want)


def test_parts_of_given_licenses(spark):
    shared = "one two three four five six seven eight nine"
    own = spark.createDataFrame([("b", "Some Terms."), ("a", "some terms"), ("c", f"{shared}\n\nx c"), ("d", f"{shared}\n\nx d"), ("e", None)], "license_id string, text string")
    texts = list(enumerate(["p\nSOME terms", shared, f"{shared}\n\nX, d"]))
    assert looked_up(spark, texts, own) == brute.Counter([(0, None, "a"), (1, None, ""), (2, "d", "")])


def test_columns_with_clashing_names(spark):
    rows = brute.odd_rows()
    docs = brute.documents(spark, rows)
    for name in ("digest", "license_id", "stated", "row", "form", "part"):
        docs = docs.withColumn(name, docs["key"])
    assert sorted(map(str, licenses.find_licenses(docs).collect())) == sorted(map(str, licenses.find_licenses(brute.documents(spark, rows)).collect()))


def test_no_python_runs(spark):
    plan = queries.op9_licenses(spark, brute.SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_query_finds_every_line(spark):
    lines = {t: i for i, t in licenses.NOTICES}
    folder = "/root/testdata/sf0.01"
    want = {}
    for r in brute.pq.read_table(f"{folder}/documents.parquet").to_pylist():
        want[r["doc_id"]] = ",".join(sorted({lines[x.strip()] for x in (r["text"] or "").split("\n") if x.strip() in lines}))
    got = {r["doc_id"]: r["stated"] for r in queries.op9_licenses(spark, folder).collect()}
    assert got == want and sum(map(bool, want.values())) > 20
