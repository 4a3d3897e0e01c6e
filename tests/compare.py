"""Compare a Spark result with DuckDB's: columns by name, rows in any order, floats to nine digits."""

import decimal
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if value != value else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


def same(spark_df, sql: str, sf_dir: str = SF) -> None:
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{sf_dir}/{name}'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(spark_df.columns) == sorted(names)
    want, have = rows_of(names, got.fetchall()), rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    assert len(have) == len(want)
    assert have == want
