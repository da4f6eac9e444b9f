"""Run registered queries beside their oracle SQL and compare rows as multisets.

    python -m checks.compare SF_DIR [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from collections import Counter

import duckdb

# The driver's tables.
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, decimal.Decimal):
        return str(value.normalize())
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return value


def multiset(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    from checks.registry import ORACLE, QUERIES

    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    took = time.time() - start
    if name not in ORACLE:
        return True, f"{len(rows)} rows (no SQL) {took:.1f}s"
    cursor = con.execute(ORACLE[name])
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    want = cursor.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    left, right = multiset(df.columns, rows), multiset(names, want)
    types = ", ".join(f"{n}:{t}/{kinds[n]}" for n, t in sorted(df.dtypes))
    if left == right:
        return True, f"{len(rows)} rows {took:.1f}s  [{types}]"
    only_spark = list((left - right).items())[:3]
    only_sql = list((right - left).items())[:3]
    return False, (
        f"{len(rows)} vs {len(want)} rows [{types}]\n   spark: {only_spark}\n   sql: {only_sql}"
    )


def main() -> None:
    from checks.registry import QUERIES
    from matchspark.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = local_session()
    con = duck(sf_dir)
    bad = 0
    for name in names or QUERIES:
        try:
            good, text = compare(spark, con, name, sf_dir)
        except Exception as error:  # report and go on with the next query
            good, text = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not good
        print("ok  " if good else "FAIL", name, text, flush=True)
    print("failed:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
