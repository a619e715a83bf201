"""Text tables and result files, over a small shop written here."""

from collections import Counter

import pytest

from tessera.engine import Engine
from tessera.plans.model import AnalysisError
from tessera.sources import datagen, sink
from tessera.sources.text import parse_det, parse_stat, read_text, write_text

GOODS = "3\n20\nid INTEGER 100 PK 4 \r\nname STRING 8 NK 8\r\nopens TIME 24 NK 8\r\n"
PRICES = "2\n8\nid INTEGER 100 FK 4\nprice REAL 10 NK 4\n"


@pytest.fixture
def shop(spark, tmp_path):
    (tmp_path / "G.det").write_text(GOODS)
    (tmp_path / "G.txt").write_text("7\tnuts\t08:30:00\t\n9\tbolts\t17:00:01\t\n\n12\tnuts\t00:00:00\t\n")
    (tmp_path / "P.det").write_text(PRICES)
    (tmp_path / "P.txt").write_text("9\t0.1\t\n7\t2.5\t\n9\t0.1\t\n")
    e = Engine(spark)
    for t in "GP":
        e.catalog.register_text(t, str(tmp_path / f"{t}.det"), str(tmp_path / f"{t}.txt"))
    return e


def test_types_and_rows(shop):
    assert [f.dataType.simpleString() for f in shop.catalog["G"].schema] == ["int", "string", "int"]
    assert sorted(map(tuple, shop.catalog["G"].collect())) == [(7, "nuts", 30600), (9, "bolts", 61201), (12, "nuts", 0)]


def test_real_literals_have_the_columns_type(shop):
    assert shop.query('SELECT P.id FROM P WHERE P.price="0.1"').count() == 2


def test_bag_join_and_result_file(shop, tmp_path):
    text = 'SELECT G.opens, P.price, G.name FROM P, G WHERE P.id=G.id, G.opens>"08:00:00" ORDERBY G.id'
    assert shop.write(text, str(tmp_path / "out")) == 3
    assert (tmp_path / "out").read_text() == "G.opens  P.price  G.name  \n08:30:00\t2.5\tnuts\t\n" + "17:00:01\t0.1\tbolts\t\n" * 2
    sink.write_folder(shop.plan(text), str(tmp_path / "parts"))
    assert Counter(line for p in (tmp_path / "parts").glob("part-*") for line in p.read_text().splitlines())["17:00:01\t0.1\tbolts\t"] == 2


def test_stats(shop):
    assert shop.catalog.stats("G").collect()[0].asDict() == {"n_tuples": 3, "v_id": 3, "v_name": 2, "v_opens": 3}
    assert parse_stat("350\n350\t2\t350\t") == (350, [350, 2, 350])


def test_malformed(shop, spark, tmp_path):
    with pytest.raises(AnalysisError):
        parse_det("2\n8\nid INTEGER 100 PK 4\n")
    with pytest.raises(AnalysisError):
        parse_det("1\n8\nid BLOB 100 PK 4\n")
    (tmp_path / "bad.txt").write_text("x\t1.0\t\n")
    shop.catalog.register_text("Bad", str(tmp_path / "P.det"), str(tmp_path / "bad.txt"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        shop.catalog["Bad"].collect()


@pytest.mark.parametrize("line", ["7\tnuts\t25:00:00\t", "7\tnuts\t10:60:00\t", "7\tnuts\tnoon\t", "7\tnuts\t", "7\tnuts\t10:00:00\tmore\t", "x7\tnuts\t10:00:00\t"])
def test_malformed_rows_are_errors(shop, tmp_path, line):
    (tmp_path / "bad.txt").write_text(f"8\tnuts\t10:00:00\t\n{line}\n")
    shop.catalog.register_text("Bad", str(tmp_path / "G.det"), str(tmp_path / "bad.txt"))
    with pytest.raises(Exception, match="not a time of day|without 3 values|CAST_INVALID_INPUT"):
        shop.catalog["Bad"].collect()


def test_written_text_is_read_again(shop, spark, tmp_path):
    columns = parse_det(GOODS)
    rows = datagen.generate(spark, columns, 100, seed=3)
    write_text(rows, columns, str(tmp_path / "W.det"), str(tmp_path / "W.txt"))
    got = read_text(spark, str(tmp_path / "W.det"), str(tmp_path / "W.txt"))
    told = lambda df: [(f.name, f.dataType, f.metadata) for f in df.schema]
    assert told(got) == told(rows) and sorted(got.collect()) == sorted(rows.collect())
    with pytest.raises(Exception, match="text can't hold"):
        write_text(rows.withColumn("name", rows["name"].substr(1, 0)), columns, str(tmp_path / "X.det"), str(tmp_path / "X.txt"))


def test_generator_is_seeded_and_keyed(spark):
    columns = parse_det(GOODS)
    a = datagen.generate(spark, columns, 100, seed=1)
    assert a.collect() == datagen.generate(spark, columns, 100, seed=1).collect()
    assert a.collect() != datagen.generate(spark, columns, 100, seed=2).collect()
    rows = a.collect()
    assert {r[0] for r in rows} == set(range(100))
    assert all(len(r[1]) == 8 and r[1].isalpha() and 0 <= r[2] < 86400 for r in rows)
    with pytest.raises(AnalysisError):
        datagen.generate(spark, columns, 101)
