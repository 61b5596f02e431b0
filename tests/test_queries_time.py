"""Every query on long series, sessions, alignment and options against its SQL."""

import math

import duckdb
import pytest

from quantloom import queries_time as Q

SF = "/root/testdata/sf0.001"


def key(row):
    return [(v is None, str(type(v)), v if not isinstance(v, float) else round(v, 4)) for v in row]


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS FROM '{SF}/events.parquet'")
    df = Q.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(Q.oracle_sql()[name])
    assert sorted(want.columns) == cols
    a = sorted(([r[c] for c in cols] for r in df.collect()), key=key)
    b = sorted(([r[want.columns.index(c)] for c in cols] for r in want.fetchall()), key=key)
    assert len(a) == len(b) > 0
    for x, y in zip(a, b):
        for p, q in zip(x, y):
            assert p == q or (isinstance(p, float) and isinstance(q, float) and (math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6) or (math.isnan(p) and math.isnan(q)))), (x, y)


@pytest.mark.parametrize("name", ["blocked_signal", "blocked_backtest_metrics"])
def test_averages_that_tie_cross_as_in_sql(spark, name, tmp_path):
    """Few different prices: averages of 5 and 20 bars are often equal by their decimals, in every block."""
    con = duckdb.connect()
    con.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + i // 2 * INTERVAL 1 HOUR AS ts, 0 AS user_id, CASE WHEN i % 2 = 0 THEN 'view' ELSE 'click' END AS event_type,
        1.1 + hash(i) % 4 / 10.0 AS value FROM range(1801) t(i)) TO '{tmp_path}/events.parquet'""")
    con.sql(f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet'")
    df = Q.queries()[name](spark, str(tmp_path))
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({Q.oracle_sql()[name]})").fetchall()
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(want) and len({r[:2] for r in rows}) == len(rows)
    for a, b in zip(sorted(rows, key=lambda r: r[:2]), sorted(want, key=lambda r: r[:2])):
        assert a == b if name == "blocked_signal" else (a[0], a[1:]) == (b[0], pytest.approx(b[1:], rel=1e-9, abs=2e-6, nan_ok=True))
