"""Every query with SQL gives DuckDB's rows."""

import duckdb
import pytest
from tidewatch.plans import catalog, control, intake, legs, made, tap

assert legs and control and intake and made and tap  # they add their queries to the catalog

SF, LARGE = "/root/testdata/sf0.01", "/root/testdata/sf0.1"
#: Held against DuckDB on the larger tables too.
ON_LARGE = ["composition", "deciles", "digest_rank", "history_read", "noise_top_checks", "psi", "river", "running_count", "tap_observations", "team_load", "volume_guard"]
TABLES = "nation customer orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def duck():
    return {sf: connected(sf) for sf in (SF, LARGE)}


def connected(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def norm(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(float(r[i])) if isinstance(r[i], float) or type(r[i]).__name__ == "Decimal" else str(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name,sf", [*((n, SF) for n in sorted(catalog.ORACLES)), *((n, LARGE) for n in ON_LARGE)])
def test_oracle(spark, duck, name, sf):
    df = catalog.QUERIES[name](spark, sf)
    want = duck[sf].execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert norm(df.columns, df.collect()) == norm(columns, want.fetchall())
