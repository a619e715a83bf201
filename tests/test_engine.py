from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from tessera import suite
from tessera.engine import Engine
from tessera.functions.types import TIME_METADATA
from tessera.plans.model import AnalysisError, Attr
from tessera.plans.planner import names

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark):
    return suite.engine(spark, SMALL)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def bag(rows):
    return Counter(tuple(r) for r in rows)


@pytest.mark.parametrize("name", sorted(suite.ORACLE_SQL))
def test_suite_agrees_with_sql(spark, duck, name):
    got = suite.QUERIES[name](spark, SMALL)
    want = duck.execute(suite.ORACLE_SQL[name])
    assert got.columns == [c[0] for c in want.description]
    assert bag(got.collect()) == bag(want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["orderby_multi", "orderby_hidden_key", "orderby_join"])
def test_order(spark, duck, name):
    assert [tuple(r) for r in suite.QUERIES[name](spark, SMALL).collect()] == duck.execute(suite.ORACLE_SQL[name]).fetchall()


def test_filters_and_columns_reach_the_scan(star):
    plan = star.explain(suite.SUITE["filter_int_lt"][0])
    assert "LessThan(p_size,25)" in plan
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


@pytest.mark.parametrize(("method", "node"), [("page_nested", "CartesianProduct"), ("block_nested", "BroadcastHashJoin"), ("sort_merge", "SortMergeJoin"), ("hash", "ShuffledHashJoin")])
def test_join_methods(star, method, node):
    rows = star.query(suite.SUITE["join2_int"][0], method)
    assert node in rows._jdf.queryExecution().executedPlan().toString()
    assert bag(rows.collect()) == bag(star.query(suite.SUITE["join2_int"][0]).collect())


def test_page_nested_pairs_only_pages_whose_keys_may_meet(spark, monkeypatch):
    from tessera.operators import relational

    monkeypatch.setattr(relational, "PAGE_BITS", 2)
    e = Engine(spark)
    e.catalog.register("A", spark.createDataFrame([(i % 50 if i % 7 else None, f"s{i % 3}", float(i)) for i in range(400)], "k int, s string, v float"))
    e.catalog.register("B", spark.createDataFrame([(i % 60 if i % 5 else None, f"s{i % 4}", i / 2) for i in range(300)], "k bigint, s string, v double"))
    e.catalog.register("C", spark.createDataFrame([(i,) for i in range(3)], "id int"))
    for where in ("A.k=B.k", "B.k=A.k, A.s=B.s", "A.v=B.v", "A.k=B.k, A.v<B.v"):
        text = f"SELECT A.v, B.s, B.v FROM A, B WHERE {where}"
        rows = e.query(text, "page_nested")
        assert "CartesianProduct (outer class" in rows._jdf.queryExecution().executedPlan().toString()
        assert bag(rows.collect()) == bag(e.query(text).collect()) and rows.count()
    assert e.query("SELECT A.s FROM A, B, C WHERE A.k=B.k", "page_nested").count() == 3 * e.query("SELECT A.s FROM A, B WHERE A.k=B.k").count()
    assert e.query("SELECT A.s FROM A, B WHERE A.v<B.v", "page_nested").count() == e.query("SELECT A.s FROM A, B WHERE A.v<B.v").count()


def test_joins_without_equality_are_spread_over_tasks(spark, monkeypatch):
    from tessera.operators import relational

    monkeypatch.setattr(relational, "PAIR_BYTES", 1 << 20)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = suite.QUERIES["join_theta"](spark, SMALL)
        assert "BroadcastNestedLoopJoin" in rows._jdf.queryExecution().executedPlan().toString() and rows.rdd.getNumPartitions() > 1
        want = bag(rows.collect())
        e = suite.engine(spark, SMALL)
        sides = [relational.scan(e.catalog[t], t) for t in ("customer", "supplier")]
        on = [(relational.column("customer.c_acctbal"), "<", relational.column("supplier.s_acctbal"))]
        for both in (sides, sides[::-1]):
            for most in (0, 1 << 30):
                got = relational.join(*both, on, broadcast_bytes=most)
                assert bag(got.select("`customer.c_custkey`", "`supplier.s_suppkey`").collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_joins_by_order_are_written_in_few_bytes(spark, monkeypatch, tmp_path):
    from tessera.operators import relational

    monkeypatch.setattr(relational, "PAIR_BYTES", 1 << 28)
    suite.QUERIES["join_theta"](spark, "/root/testdata/sf0.1").write.parquet(str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7_547_704
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 7_547_704 / 3


def test_joins_in_runs_give_what_pairs_give(spark, monkeypatch, tmp_path):
    from tessera.operators import relational

    nan, inf = float("nan"), float("inf")
    values = [None, nan, inf, -inf, 0.0, -0.0, 1.5, 2.0, 2.0, 2.0, 3.0, 7.0]
    e = Engine(spark)
    at = suite.F.col("i").alias("at", metadata=TIME_METADATA)
    for name, rows, columns in (
        ("A", [(i, v, i % 5) for i, v in enumerate(values * 3)], "i int, v double, n int"),
        ("B", [(i, v, i % 3) for i, v in enumerate([*values[::-1], 4.0])], "j bigint, w float, m bigint"),
        ("C", [(i, i % 3) for i in range(7)], "k int, o smallint"),
        ("S", [(i, "x" * i) for i in range(7)], "z int, s string"),
    ):
        rows = spark.createDataFrame(rows, columns).coalesce(2)
        (rows.select("*", at) if name == "A" else rows).write.parquet(str(tmp_path / name))  # with a known size
        e.catalog.register_parquet(name, str(tmp_path / name))
    queries = [f"SELECT * FROM {tables} WHERE {cond}" for op in ("<", "<=", ">", ">=") for tables in ("A, B", "B, A") for cond in (f"A.v{op}B.w", f"B.w{op}A.v", f"A.n!=B.m, A.n{op}B.m, B.w{op}A.v")]
    queries += ["SELECT A.at, C.k FROM A, B, C WHERE A.v<B.w, B.m>C.k, A.n<=C.o", "SELECT B.j, S.s FROM B, S WHERE B.j>S.z", 'SELECT A.i, B.j FROM A, B WHERE A.v<B.w, A.i<"0"', "SELECT A.n, B.m FROM A, B WHERE A.n<B.m"]
    monkeypatch.setattr(relational, "MOST_TASKS", 1)
    plain = [e.query(q) for q in queries]
    assert not any(" least" in q._jdf.queryExecution().analyzed().toString() for q in plain)
    want = [bag([tuple(map(str, r)) for r in q.collect()]) for q in plain]
    monkeypatch.setattr(relational, "PAIR_BYTES", 1 << 4)
    monkeypatch.setattr(relational, "MOST_TASKS", 3)
    monkeypatch.setattr(relational, "RUN_BITS", 2)
    for text, before, rows in zip(queries, plain, want, strict=True):
        got = e.query(text)
        assert (" least" in got._jdf.queryExecution().analyzed().toString()) == ("S.s" not in text), text
        assert got.schema == before.schema and [f.metadata for f in got.schema] == [f.metadata for f in before.schema], text
        assert bag([tuple(map(str, r)) for r in got.collect()]) == rows, text


def test_runs_of_one_key_are_dealt_to_tasks_and_made_one_by_one(spark, monkeypatch):
    from tessera.operators import relational

    monkeypatch.setattr(relational, "PAIR_BYTES", 1 << 4)
    monkeypatch.setattr(relational, "MOST_TASKS", 4)
    e = Engine(spark)
    e.catalog.register("A", spark.range(8192).selectExpr("id as i", "1 as v"))
    e.catalog.register("B", spark.range(300).selectExpr("id as j", "2 as w"))
    rows = e.query("SELECT A.i, B.j FROM A, B WHERE A.v<B.w")
    assert "filter(" in rows._jdf.queryExecution().optimizedPlan().toString()  # not compiled with the join
    counts = [r[1] for r in rows.groupBy(suite.F.spark_partition_id()).count().collect()]
    assert sum(counts) == 8192 * 300 and max(counts) < sum(counts) / 2


def test_broadcast_only_below_its_bound(star):
    from tessera.operators import relational

    left, right = (relational.scan(star.catalog[t], t) for t in ("customer", "orders"))
    on = [(relational.column(a), "=", relational.column(b)) for a, b in [("customer.c_custkey", "orders.o_custkey")]]
    plan = relational.join(left, right, on, "block_nested", broadcast_bytes=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


def test_from_and_where_order_do_not_matter(star):
    a = star.query('SELECT nation.n_name, region.r_name FROM nation, region WHERE nation.n_regionkey=region.r_regionkey, region.r_name!="ASIA"')
    b = star.query('SELECT nation.n_name, region.r_name FROM region, nation WHERE region.r_name!="ASIA", region.r_regionkey=nation.n_regionkey')
    assert bag(a.collect()) == bag(b.collect())


@pytest.mark.parametrize(
    "text",
    [
        "SELECT * FROM nowhere",
        "SELECT nation.x FROM nation",
        "SELECT region.r_name FROM nation",
        "SELECT * FROM nation, nation",
        'SELECT * FROM nation WHERE nation.n_nationkey="x"',
        'SELECT * FROM nation WHERE nation.n_nationkey=" 12"',
        'SELECT * FROM nation WHERE nation.n_nationkey="2147483648"',
        'SELECT * FROM customer WHERE customer.c_acctbal<"one"',
        'SELECT * FROM events WHERE events.time_of_day<"24:00:00"',
        "SELECT * FROM nation, region WHERE nation.n_name=region.r_regionkey",
        'SELECT * FROM orders WHERE orders.o_orderdate="1995-01-01"',
        "SELECT * FROM nation ORDERBY region.r_name",
    ],
)
def test_analysis_errors(star, text):
    with pytest.raises(AnalysisError):
        star.query(text)


def test_nulls_names_theta_and_repeats(spark):
    e = Engine(spark)
    e.catalog.register("A", spark.createDataFrame([(1, 1.5, "x"), (2, None, None), (None, 2.5, "y"), (2, 2.5, "y")], "k int, v float, s string"))
    e.catalog.register("B", spark.createDataFrame([(2, "b"), (2, "c"), (None, "d"), (3, "e")], "k int, s string"))
    assert e.query("SELECT A.k, B.k, A.s, A.s FROM A, B WHERE A.k=B.k").columns == ["A_k", "B_k", "A_s", "A_s_2"]
    assert bag(e.query("SELECT A.k, B.s FROM A, B WHERE A.k=B.k").collect()) == Counter({(2, "b"): 2, (2, "c"): 2})
    assert e.query('SELECT A.k FROM A WHERE A.v>="1.5f"').count() == 3
    assert e.query('SELECT A.k FROM A WHERE A.s!="x"').count() == 2
    assert e.query("SELECT A.k FROM A, B WHERE A.k<B.k").count() == 1 + 1 + 1 + 2
    assert bag(Engine.query(_like(e, theta="equality"), "SELECT A.k FROM A, B WHERE A.k<B.k").collect()) == Counter({(2,): 4})
    assert bag(e.query("SELECT A.k FROM A, B WHERE A.k=B.k, A.s=B.s").collect()) == Counter()


def _like(e, **options):
    out = Engine(e.spark, **options)
    for t in e.catalog:
        out.catalog.register(t, e.catalog[t])
    return out


def test_cost_based_reordering_uses_saved_statistics(spark, star):
    e = Engine(spark, cbo=True)
    for t in ("region", "nation"):
        e.catalog.register(t, star.catalog[t])
        e.catalog.analyze(t)
    text = "SELECT nation.n_name, region.r_name FROM nation, region WHERE nation.n_regionkey=region.r_regionkey"
    assert "rowCount=25" in e.explain(text, "cost")
    assert e.query(text).count() == 25
    spark.conf.unset("spark.sql.cbo.enabled")
    spark.conf.unset("spark.sql.cbo.joinReorder.enabled")


def test_time_columns(spark, tmp_path):
    e = Engine(spark)
    table = spark.createDataFrame([(1, 3661), (2, 86399)], "id int, at int")
    e.catalog.register("T", table.select("id", table["at"].alias("at", metadata=TIME_METADATA)))
    assert [r[0] for r in e.query('SELECT T.id FROM T WHERE T.at="01:01:01"').collect()] == [1]
    path = tmp_path / "out"
    assert e.write("SELECT T.at, T.id FROM T ORDERBY T.id", str(path)) == 2
    assert path.read_text() == "T.at  T.id  \n01:01:01\t1\t\n23:59:59\t2\t\n"


def test_whole_joins_read_every_id(spark, duck):
    for name, column in (("join_theta", "c_custkey"), ("orderby_join", "c_custkey"), ("join_filter", "c_custkey")):
        top = suite.QUERIES[name](spark, SMALL).agg({column: "max"}).first()[0]
        assert top == duck.execute(f"select max({column}) from ({suite.ORACLE_SQL[name]})").fetchone()[0]
    assert {r[0] for r in suite.QUERIES["orderby_join"](spark, SMALL).select("c_custkey").collect()} == {r[0] for r in duck.execute("select o_custkey from orders").fetchall()}


def test_names_of_columns_are_distinct():
    attr = lambda text: Attr(*text.split("."))
    assert names(tuple(map(attr, ("A.k", "A.k", "A.k_2", "B.k_2")))) == ["A_k", "A_k_3", "A_k_2", "B_k_2"]
    assert names(tuple(map(attr, ("A.k", "B.j", "A.k", "A.k")))) == ["A_k", "j", "A_k_2", "A_k_3"]
