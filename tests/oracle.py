"""Compares a query's rows with those of its SQL in DuckDB, in any order."""

import decimal
import math
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 6) + 0.0
    if isinstance(x, int):
        return float(x)
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], Counter(tuple(plain(r[k]) for k in order) for r in rows)


def differences(df, sql, sf_dir):
    names, ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = db.execute(sql)
    theirs_names, theirs = rows_of([c[0] for c in got.description], got.fetchall())
    if names != theirs_names:
        return f"columns {names} and {theirs_names}"
    if ours != theirs:
        return f"{sum(ours.values())} and {sum(theirs.values())} rows; only here {list((ours - theirs).items())[:2]}; only there {list((theirs - ours).items())[:2]}"
    return None
