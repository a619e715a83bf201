"""Queries of the dialect over the star-schema tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.engine import Engine
from tessera.functions.types import TIME_METADATA
from tessera.plans.model import AnalysisError, ParseError
from tessera.sources import datagen, sink
from tessera.sources.folders import fresh_folder
from tessera.sources.text import parse_det, write_text

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
OPS = {"eq": "=", "ne": "!=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}


def engine(spark: SparkSession, sf_dir: str, text: str | None = None, **options) -> Engine:
    """An engine over the tables, or over those that ``text`` names alone, as each has a schema to read."""
    out = Engine(spark, **options)
    asked = (lambda name: text is None or f"{name}." in text or f"{name} " in f"{text} ")
    for name in TABLES:
        if asked(name):
            out.catalog.register_parquet(name, f"{sf_dir}/{name}.parquet")
    if asked("lineitem_real"):
        items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        out.catalog.register("lineitem_real", items.withColumn("discount_real", F.col("l_discount").cast("float")))
    if asked("events"):
        events = spark.read.parquet(f"{sf_dir}/events.parquet")
        at = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
        out.catalog.register("events", events.select("event_id", at.alias("time_of_day", metadata=TIME_METADATA)))
    return out


def _suite() -> dict[str, tuple[str, str]]:
    out = {
        "scan_star": ("SELECT * FROM nation", "select * from nation"),
        "project_reorder": ("SELECT nation.n_name, nation.n_nationkey FROM nation", "select n_name, n_nationkey from nation"),
        "project_bag": ("SELECT orders.o_orderpriority FROM orders", "select o_orderpriority from orders"),
    }
    for name, op in OPS.items():
        sql = "<>" if op == "!=" else op
        at = "01:25:41" if op in ("=", "!=") else "12:00:00"
        second = 5141 if op in ("=", "!=") else 43200
        out |= {
            f"filter_int_{name}": (f'SELECT part.p_partkey, part.p_size FROM part WHERE part.p_size{op}"25"', f"select p_partkey, p_size from part where p_size {sql} 25"),
            f"filter_string_{name}": (f'SELECT orders.o_orderkey, orders.o_orderpriority FROM orders WHERE orders.o_orderpriority{op}"3-MEDIUM"', f"select o_orderkey, o_orderpriority from orders where o_orderpriority {sql} '3-MEDIUM'"),
            f"filter_real_{name}": (
                f'SELECT lineitem_real.l_orderkey, lineitem_real.l_linenumber, lineitem_real.l_discount FROM lineitem_real WHERE lineitem_real.discount_real{op}"0.05"',
                f"select l_orderkey, l_linenumber, l_discount from lineitem where cast(l_discount as float) {sql} cast('0.05' as float)",
            ),
            f"filter_time_{name}": (f'SELECT events.event_id FROM events WHERE events.time_of_day{op}"{at}"', f"select event_id from events where hour(ts)*3600+minute(ts)*60+second(ts) {sql} {second}"),
        }
    chain3 = "FROM customer, orders, lineitem WHERE customer.c_custkey=orders.o_custkey, orders.o_orderkey=lineitem.l_orderkey"
    sql3 = "from customer, orders, lineitem where c_custkey=o_custkey and o_orderkey=l_orderkey"
    return out | {
        "filter_conj": ('SELECT customer.c_custkey FROM customer WHERE customer.c_nationkey>="5", customer.c_nationkey<"10", customer.c_acctbal>"0"', "select c_custkey from customer where c_nationkey>=5 and c_nationkey<10 and c_acctbal>0"),
        "filter_empty": ('SELECT customer.c_custkey FROM customer WHERE customer.c_custkey<"0"', "select c_custkey from customer where c_custkey<0"),
        "filter_columns": ("SELECT lineitem.l_orderkey, lineitem.l_linenumber FROM lineitem WHERE lineitem.l_discount=lineitem.l_tax", "select l_orderkey, l_linenumber from lineitem where l_discount=l_tax"),
        "join2_int": ("SELECT customer.c_custkey, customer.c_name, orders.o_orderkey, orders.o_orderstatus FROM customer, orders WHERE customer.c_custkey=orders.o_custkey", "select c_custkey, c_name, o_orderkey, o_orderstatus from customer, orders where c_custkey=o_custkey"),
        "join2_string": (
            "SELECT orders.o_orderkey, lineitem.l_orderkey, lineitem.l_linenumber FROM orders, lineitem WHERE orders.o_orderstatus=lineitem.l_linestatus, orders.o_orderkey=lineitem.l_orderkey",
            "select o_orderkey, l_orderkey, l_linenumber from orders, lineitem where o_orderstatus=l_linestatus and o_orderkey=l_orderkey",
        ),
        "join3_chain": (f"SELECT orders.o_orderkey, lineitem.l_linenumber {chain3}", f"select o_orderkey, l_linenumber {sql3}"),
        "join4_chain": (
            "SELECT region.r_name, nation.n_name, customer.c_custkey, orders.o_orderkey FROM region, nation, customer, orders WHERE region.r_regionkey=nation.n_regionkey, nation.n_nationkey=customer.c_nationkey, customer.c_custkey=orders.o_custkey",
            "select r_name, n_name, c_custkey, o_orderkey from region, nation, customer, orders where r_regionkey=n_regionkey and n_nationkey=c_nationkey and c_custkey=o_custkey",
        ),
        "join4_star": (
            "SELECT lineitem.l_orderkey, lineitem.l_linenumber, part.p_brand, supplier.s_name, orders.o_orderstatus FROM lineitem, part, supplier, orders WHERE lineitem.l_partkey=part.p_partkey, lineitem.l_suppkey=supplier.s_suppkey, lineitem.l_orderkey=orders.o_orderkey",
            "select l_orderkey, l_linenumber, p_brand, s_name, o_orderstatus from lineitem, part, supplier, orders where l_partkey=p_partkey and l_suppkey=s_suppkey and l_orderkey=o_orderkey",
        ),
        "join5_snow": (
            'SELECT region.r_name, orders.o_orderkey, lineitem.l_linenumber FROM region, nation, customer, orders, lineitem WHERE region.r_regionkey=nation.n_regionkey, nation.n_nationkey=customer.c_nationkey, customer.c_custkey=orders.o_custkey, orders.o_orderkey=lineitem.l_orderkey, region.r_name="ASIA"',
            "select r_name, o_orderkey, l_linenumber from region, nation, customer, orders, lineitem where r_regionkey=n_regionkey and n_nationkey=c_nationkey and c_custkey=o_custkey and o_orderkey=l_orderkey and r_name='ASIA'",
        ),
        "join_filter": (f'SELECT customer.c_custkey {chain3}, customer.c_mktsegment="BUILDING"', f"select c_custkey {sql3} and c_mktsegment='BUILDING'"),
        "join_multi_cond": ("SELECT customer.c_custkey, supplier.s_suppkey FROM customer, supplier WHERE customer.c_nationkey=supplier.s_nationkey, customer.c_custkey=supplier.s_suppkey", "select c_custkey, s_suppkey from customer, supplier where c_nationkey=s_nationkey and c_custkey=s_suppkey"),
        "join_cyclic": (
            "SELECT customer.c_custkey, supplier.s_suppkey, nation.n_name FROM customer, nation, supplier WHERE customer.c_nationkey=nation.n_nationkey, supplier.s_nationkey=nation.n_nationkey, customer.c_nationkey=supplier.s_nationkey",
            "select c_custkey, s_suppkey, n_name from customer, nation, supplier where c_nationkey=n_nationkey and s_nationkey=n_nationkey and c_nationkey=s_nationkey",
        ),
        "join_theta": ("SELECT customer.c_custkey, supplier.s_suppkey FROM customer, supplier WHERE customer.c_acctbal<supplier.s_acctbal", "select c_custkey, s_suppkey from customer, supplier where c_acctbal<s_acctbal"),
        "join_empty_side": ('SELECT customer.c_custkey, orders.o_orderkey FROM customer, orders WHERE customer.c_custkey=orders.o_custkey, customer.c_custkey<"0"', "select c_custkey, o_orderkey from customer, orders where c_custkey=o_custkey and c_custkey<0"),
        "cross_join": ("SELECT region.r_name, nation.n_name FROM region, nation", "select r_name, n_name from region, nation"),
        "orderby_multi": ("SELECT customer.c_custkey, customer.c_nationkey FROM customer ORDERBY customer.c_nationkey, customer.c_custkey", "select c_custkey, c_nationkey from customer order by c_nationkey, c_custkey"),
        "orderby_hidden_key": ("SELECT customer.c_name FROM customer ORDERBY customer.c_acctbal, customer.c_custkey", "select c_name from customer order by c_acctbal, c_custkey"),
        "orderby_join": (
            "SELECT customer.c_custkey, orders.o_orderkey FROM customer, orders WHERE customer.c_custkey=orders.o_custkey ORDERBY customer.c_custkey, orders.o_orderkey",
            "select c_custkey, o_orderkey from customer, orders where c_custkey=o_custkey order by c_custkey, o_orderkey",
        ),
        "project_repeated": ("SELECT nation.n_name, nation.n_regionkey, nation.n_name FROM nation", "select n_name as nation_n_name, n_regionkey, n_name as nation_n_name_2 from nation"),
    }


#: name -> (text in the dialect, SQL)
SUITE = _suite()
METHODS = ("page_nested", "block_nested", "sort_merge", "hash")
#: The page-nested method pairs all pages, so it runs on a join of small sides.
METHOD_QUERY = {m: "join_multi_cond" if m == "page_nested" else "join3_chain" for m in METHODS}
STATS = "select count(*) as n_tuples, count(distinct c_custkey) as v_custkey, count(distinct c_nationkey) as v_nationkey, count(distinct c_mktsegment) as v_mktsegment from customer"
RESULT_LINES = "select concat(n_name, chr(9), cast(n_nationkey as varchar), chr(9)) as value from nation"
#: A declaration for the generator, in the text format of table declarations.
GENERATED = """4
26
id INTEGER 5000 PK 4
name STRING 10 NK 10
price REAL 100 NK 4
opens TIME 24 NK 8
"""
#: Events declared as text.
EVENTS = """4
36
id INTEGER 2000000000 PK 4
kind STRING 20 NK 20
value REAL 1000000 NK 4
at TIME 24 NK 8
"""
#: A comparison that the setting "equality" takes for =.
SAME_KEY = "SELECT customer.c_custkey, supplier.s_suppkey FROM customer, supplier WHERE customer.c_custkey<supplier.s_suppkey"
#: Queries that are refused.
REFUSED = {
    "types": "SELECT customer.c_custkey FROM customer, nation WHERE customer.c_custkey=nation.n_name",
    "table": "SELECT planet.p_name FROM planet",
    "column": "SELECT nation.n_size FROM nation",
    "literal": 'SELECT nation.n_name FROM nation WHERE nation.n_nationkey="five"',
    "table twice": "SELECT nation.n_name FROM nation, nation",
    "distinct": "SELECT DISTINCT nation.n_name FROM nation",
    "or": 'SELECT nation.n_name FROM nation WHERE nation.n_nationkey="5" || nation.n_nationkey="6"',
    "semicolon": "SELECT nation.n_name FROM nation;",
}


def _text(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, SUITE[name][0]).query(SUITE[name][0])


def _method(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: engine(spark, sf_dir, SUITE[METHOD_QUERY[method]][0]).query(SUITE[METHOD_QUERY[method]][0], method)


def _stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = engine(spark, sf_dir, "customer").catalog.stats("customer", ["c_custkey", "c_nationkey", "c_mktsegment"])
    return stats.withColumnsRenamed({f"v_c_{c}": f"v_{c}" for c in ("custkey", "nationkey", "mktsegment")})


def _result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sink.lines(engine(spark, sf_dir, SUITE["project_reorder"][0]).plan(SUITE["project_reorder"][0]))


def _result_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = SUITE["project_reorder"][0]
    return sink.whole(engine(spark, sf_dir, text).plan(text))


def _datagen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datagen.generate(spark, parse_det(GENERATED), 5000, seed=42)


def _datagen_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _datagen(spark, sf_dir)
    inside = (F.col("price") >= 0) & (F.col("price") < 100) & (F.col("opens") >= 0) & (F.col("opens") < 86400)
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("id").alias("n_ids"),
        F.min("id").alias("least_id"),
        F.max("id").alias("most_id"),
        F.min(F.length("name")).alias("shortest"),
        F.max(F.length("name")).alias("longest"),
        F.bool_and(inside).alias("in_range"),
    )


def _text_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as text and read again."""
    folder = fresh_folder(spark, "text")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    at = F.hour("ts") * 3600 + F.minute("ts") * 60 + F.second("ts")
    rows = events.select(F.col("event_id").cast("int").alias("id"), F.col("event_type").alias("kind"), F.col("value").cast("float").alias("value"), at.alias("at"))
    write_text(rows, parse_det(EVENTS), f"{folder}/events.det", f"{folder}/events.txt")
    out = Engine(spark)
    out.catalog.register_text("E", f"{folder}/events.det", f"{folder}/events.txt")
    return out.query("SELECT E.id, E.kind, E.value, E.at FROM E")


def _theta_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, SAME_KEY, theta="equality").query(SAME_KEY)


def _plan_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = SUITE["orderby_hidden_key"][0].replace(" ORDERBY", ', nation WHERE customer.c_nationkey=nation.n_nationkey, nation.n_name!="NATION_0" ORDERBY')
    return spark.createDataFrame([(engine(spark, sf_dir, text).plan(text).shape,)], "shape string")


def _join_by_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join of saved tables, whose order Spark chooses by their statistics."""
    text = SUITE["join4_chain"][0]
    out, folder = engine(spark, sf_dir, text, cbo=True), fresh_folder(spark, "saved")
    for name in ("region", "nation", "customer", "orders"):
        out.catalog.analyze(name, path=f"{folder}/{name}")
    return out.query(text)


def _refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of queries that are not right."""
    out = []
    for case, text in REFUSED.items():
        try:
            engine(spark, sf_dir, text).plan(text)
            out.append((case, "none"))
        except (ParseError, AnalysisError) as error:
            out.append((case, type(error).__name__))
    return spark.createDataFrame(out, "case string, error string")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{name: _text(name) for name in SUITE},
    **{f"join_method_{m}": _method(m) for m in METHODS},
    "table_stats": _stats,
    "result_lines": _result_lines,
    "result_file": _result_file,
    "datagen": _datagen,
    "datagen_stats": _datagen_stats,
    "text_loader": _text_loader,
    "join_theta_equality": _theta_equality,
    "plan_shape": _plan_shape,
    "join_by_cost": _join_by_cost,
    "refused": _refused,
}
ORACLE_SQL: dict[str, str] = {
    **{name: sql for name, (_, sql) in SUITE.items()},
    **{f"join_method_{m}": SUITE[q][1] for m, q in METHOD_QUERY.items()},
    "table_stats": STATS,
    "result_lines": RESULT_LINES,
    "result_file": f"select 'nation.n_name  nation.n_nationkey  ' as value union all {RESULT_LINES}",
    "datagen_stats": "select 5000 as n, 5000 as n_ids, 0 as least_id, 4999 as most_id, 10 as shortest, 10 as longest, true as in_range",
    "text_loader": "select cast(event_id as integer) as id, event_type as kind, cast(value as float) as value, cast(hour(ts)*3600+minute(ts)*60+second(ts) as integer) as at from events",
    "join_theta_equality": "select c_custkey, s_suppkey from customer, supplier where c_custkey=s_suppkey",
    "plan_shape": "select 'Project(OrderBy(Join(customer [customer.c_nationkey = nation.n_nationkey] Select(nation [nation.n_name != \"NATION_0\"])) [customer.c_acctbal, customer.c_custkey]) [customer.c_name])' as shape",
    "join_by_cost": SUITE["join4_chain"][1],
    "refused": "select * from (values ('types', 'AnalysisError'), ('table', 'AnalysisError'), ('column', 'AnalysisError'), ('literal', 'AnalysisError'), ('table twice', 'AnalysisError'), ('distinct', 'ParseError'), ('or', 'ParseError'), ('semicolon', 'ParseError')) as t(\"case\", error)",
}
