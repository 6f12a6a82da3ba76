"""Comparing a query with its SQL run by DuckDB over the same tables."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for name in TABLES:
        c.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return c


def shown(value) -> str:
    if value is None or value != value:
        return "null"
    if isinstance(value, bool):
        return str(value)
    try:
        return f"{float(value):.6f}".rstrip("0").rstrip(".") if not isinstance(value, str) else value
    except (TypeError, ValueError):
        return str(value)


def same(df, connection, sql: str) -> None:
    columns = sorted(df.columns)
    result = connection.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    expected = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in result.fetchall())
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    assert got == expected
