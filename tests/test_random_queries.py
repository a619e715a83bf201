"""Random queries of the dialect over tiny tables, against DuckDB."""

import random
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tessera.engine import Engine
from tessera.suite import OPS


@pytest.fixture(scope="module")
def tables(spark):
    dice = random.Random(5)
    e, con = Engine(spark), duckdb.connect()
    for t, n in (("A", 30), ("B", 20), ("C", 12), ("D", 0)):
        rows = [(dice.randrange(6), dice.randrange(6), dice.choice("xyz")) for _ in range(n)]
        frame = pd.DataFrame({"a": pd.array([r[0] for r in rows], "int32"), "b": pd.array([r[1] for r in rows], "int32"), "s": pd.array([r[2] for r in rows], "str")})
        e.catalog.register(t, spark.createDataFrame(rows, "a int, b int, s string"))
        con.execute(f'create table "{t}" as select cast(a as int) a, cast(b as int) b, cast(s as varchar) s from frame')
    return e, con


@pytest.mark.parametrize("seed", range(25))
def test_agrees(tables, seed):
    e, con = tables
    dice = random.Random(seed)
    chosen = dice.sample("ABC" if seed % 5 else "ABCD", dice.randrange(1, 4))
    attr = lambda kinds="abs": f"{dice.choice(chosen)}.{dice.choice(kinds)}"
    conds, sql = [], []
    for _ in range(dice.randrange(0, 5)):
        op = dice.choice([*OPS.values()] + ["="] * 4)
        kinds = dice.choice(["ab", "s"])
        left = attr(kinds)
        value = str(dice.randrange(6)) if kinds == "ab" else dice.choice("xyz")
        right, other = (f'"{value}"', f"'{value}'" if kinds == "s" else value) if dice.random() < 0.4 else (attr(kinds),) * 2
        conds.append(left + op + right)
        sql.append(f"{left} {op} {other}")
    select = [attr() for _ in range(dice.randrange(1, 4))]
    order = [attr() for _ in range(dice.randrange(0, 3))]
    text = f"SELECT {', '.join(select)} FROM {', '.join(chosen)}" + (f" WHERE {', '.join(conds)}" if conds else "") + (f" ORDERBY {', '.join(order)}" if order else "")
    want = con.execute(f"select {', '.join(select)} from {', '.join(chosen)}" + (f" where {' and '.join(sql)}" if sql else "")).fetchall()
    got = [tuple(r) for r in e.query(text).collect()]
    assert Counter(got) == Counter(want), text
    keys = [o for o in order if o in select]
    if order and order[0] in keys:
        first = [r[select.index(order[0])] for r in got]
        assert first == sorted(first)
