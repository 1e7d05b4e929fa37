"""Rows of a query against rows of its SQL."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 8) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return str(value)


def database(sf_dir):
    found = duckdb.connect()
    for name in TABLES:
        found.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return found


def both(spark, connection, sf_dir, query, sql):
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in names) for r in df.collect())
    result = connection.execute(sql)
    place = {c[0]: i for i, c in enumerate(result.description)}
    assert sorted(place) == names
    theirs = sorted(tuple(plain(r[place[c]]) for c in names) for r in result.fetchall())
    return ours, theirs
