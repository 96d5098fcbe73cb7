"""Runs a query and its SQL over the same tables and compares them as bags."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql, sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    relation = con.sql(sql)
    return sorted(relation.columns), [dict(zip(relation.columns, r, strict=True)) for r in relation.fetchall()]


def plain(value):
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def bag(rows):
    return Counter(tuple((k, plain(v)) for k, v in sorted(r.items())) for r in rows)


def assert_same(df, sql, sf_dir):
    columns, wanted = rows_of_sql(sql, sf_dir)
    assert sorted(df.columns) == columns
    got = bag(r.asDict() for r in df.collect())
    wanted = bag(wanted)
    assert got == wanted, (list((got - wanted).items())[:3], list((wanted - got).items())[:3])


def small(name="sf0.001"):
    return os.path.join("/root/testdata", name)
