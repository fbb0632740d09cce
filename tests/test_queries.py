"""Every registered query of the main package against its SQL in DuckDB."""

import math

import duckdb
import pytest

from isoweave import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, (int, float)):
        return round(float(v), 8)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    got = registry.QUERIES[name](spark, data)
    cols = sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in cols) for r in got.collect()), key=str)
    if name not in registry.SQL:
        assert rows
        return
    out = duck.execute(registry.SQL[name])
    names = [d[0] for d in out.description]
    assert sorted(names) == cols
    assert rows == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in out.fetchall()), key=str)


def broadcast_tables(node):
    """What the leaves below a plan's broadcast sides read, as text."""
    children = [node.children().apply(i) for i in range(node.children().size())]
    if node.nodeName() == "BroadcastHashJoin":
        left = str(node.buildSide()) == "BuildLeft"
        yield str(children[0 if left else 1].collectLeaves())
    for c in children:
        yield from broadcast_tables(c)


def test_bicubic_broadcasts_no_points(spark, data):
    """Points grow with customers, so they must stay out of the driver, however small their files are."""
    plan = registry.QUERIES["bicubic"](spark, data)._jdf.queryExecution().sparkPlan()
    sent = list(broadcast_tables(plan))
    assert sent and not any("c_custkey" in s for s in sent)


def test_bicubic_values(spark, tmp_path):
    """Whole blocks, blocks with holes and repeated points; prices are such that no value is a tie of rounding."""
    c = duckdb.connect()
    c.sql(f"copy (select k as c_custkey from range(200) t(k) union all select k from range(0, 200, 3) t(k) union all select null) to '{tmp_path}/customer.parquet'")
    cells = "select x as l_partkey, y as l_suppkey, (100 * (1 + (x * x * 31 + y * 17 + x * y * 7) % 97))::double as l_extendedprice, f as l_returnflag, timestamp '2024-01-15' + interval (m) month as l_shipdate from range(20) a(x), range(20) b(y), (values ('A'), ('N')) c(f), range(3) d(m)"
    c.sql(f"copy (select * from ({cells}) where l_returnflag = 'A' or (l_partkey * 3 + l_suppkey) % 23 > 0 and (l_partkey < 6 or month(l_shipdate) > 1)) to '{tmp_path}/lineitem.parquet'")
    for t in ("customer", "lineitem"):
        c.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    key = lambda rows: sorted((tuple(plain(v) for v in r) for r in rows), key=str)
    want = c.sql(f"select point, variable, time_id, value from ({registry.SQL['bicubic']})").fetchall()
    assert any(r[3] is None for r in want) and any(r[3] is not None for r in want)
    assert key(registry.QUERIES["bicubic"](spark, str(tmp_path)).select("point", "variable", "time_id", "value").collect()) == key(want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
