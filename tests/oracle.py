"""Side-by-side run of a query on Spark and of its SQL on DuckDB, order-insensitive."""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

from offerloom.plans.tables import BASE


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in BASE:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


TIMES: dict[str, float] = {}


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime) and value.tzinfo:
        return value.astimezone(datetime.timezone.utc).replace(tzinfo=None)
    return value


def as_bag(columns, rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else a short description of the first differences."""
    start = time.time()
    spark_columns, spark_bag = as_bag(df.columns, [tuple(r) for r in df.collect()])
    TIMES["spark"] = time.time() - start
    cursor = con.execute(sql)
    duck_columns, duck_bag = as_bag([d[0] for d in cursor.description], cursor.fetchall())
    if spark_columns != duck_columns:
        return f"columns {spark_columns} vs {duck_columns}"
    if spark_bag != duck_bag:
        only_spark, only_duck = list((spark_bag - duck_bag).elements()), list((duck_bag - spark_bag).elements())
        return (f"rows {sum(spark_bag.values())} vs {sum(duck_bag.values())}; columns {spark_columns}\n"
                f"  only spark {len(only_spark)}: {sorted(map(str, only_spark))[:3]}\n  only duck {len(only_duck)}: {sorted(map(str, only_duck))[:3]}")
    return None if spark_bag else "EMPTY on both sides"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from offerloom.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    session, connection = local_session(8), connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    for key in [k for k in queries if not wanted or any(k == w or k.startswith(w + ":") for w in wanted)]:
        start = time.time()
        try:
            frame = queries[key](session, folder)
            if key in oracles:
                problem = compare(frame, connection, oracles[key])
            else:
                problem = f"rows only: {frame.count()}"
        except Exception as error:  # report and go on
            problem = f"ERROR {str(error)[:900]}"
        print(f"{key:28s} {time.time() - start:6.1f}s spark {TIMES.pop('spark', 0):5.1f}s {'ok' if problem is None else problem}", flush=True)
