"""Queries against their SQL on tables of other shapes than the smallest ones."""

import duckdb
import pytest
from test_queries import SF, rows

from assayer.plans import ORACLE, QUERIES


@pytest.fixture
def both(spark, tmp_path):
    """The rows of a query and of its SQL, with some tables replaced by SQL over the smallest ones."""

    def run(name, **tables):
        con = duckdb.connect()
        for table, sql in tables.items():
            con.sql(sql.format(SF=SF)).write_parquet(str(tmp_path / f"{table}.parquet"))
            con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
        return QUERIES[name](spark, str(tmp_path)).toPandas(), con.sql(ORACLE[name]).df()

    return run


def test_roster_beyond_its_limit(both):
    """Lines beyond the roster's limit are refused, and a name is trimmed."""
    got, want = both("src_csv_roster", customer="SELECT * REPLACE (c_custkey * 100 AS c_custkey, CASE c_custkey % 5 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE '  ' || c_name END AS c_name) FROM '{SF}/customer.parquet'")
    assert {"name missing", "too many rows"} < set(got["error"])
    assert rows(got) == rows(want)


def test_rounds_of_parts_carry_numbers(spark, monkeypatch):
    """Long names of nodes are numbered once, in their order; what each round moves and writes has numbers only."""
    from assayer.operators import graphs

    kept, staged = {}, graphs.staged
    monkeypatch.setattr(graphs, "staged", lambda df, name: kept.setdefault(name, []).append(df.dtypes) or staged(df, name))
    edges = [(f"n{i}", f"n{i + 2}") for i in range(1, 40)] + [("z", "z"), (None, "a"), ("b10", "b9")]
    got = {r.node: r.part for r in graphs.connected(spark.createDataFrame(edges, "s string, t string"), "s", "t").collect()}
    odd, even = [f"n{i}" for i in range(1, 42, 2)], [f"n{i}" for i in range(2, 42, 2)]
    assert got == {n: min(odd) for n in odd} | {n: min(even) for n in even} | {"z": "z", "b10": "b10", "b9": "b10"}
    assert {kind for dtypes in kept["stars"] for _, kind in dtypes} == {"bigint"}
