"""Hold a query's rows against DuckDB's on the same tables: ``python -m tests.compare [SF_DIR] [QUERY...]``."""

from __future__ import annotations

import math
import os
import signal
import sys
import time
from decimal import Decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(df, connection, sql: str) -> list[str]:
    """What is different; nothing when all rows are equal."""
    r = connection.execute(sql)
    names = [d[0] for d in r.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    want, got = rows(names, r.fetchall()), rows(df.columns, df.collect())
    if len(want) != len(got):
        missing, extra = [x for x in want if x not in set(got)][:3], [x for x in got if x not in set(want)][:3]
        return [f"{len(got)} rows, {len(want)} in SQL; missing {missing}, extra {extra}"]
    return [f"{g} is {w} in SQL" for g, w in zip(got, want) if g != w][:5]


def _late(*_) -> None:
    raise TimeoutError("the limit is over")


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir = next((a for a in sys.argv[1:] if a.startswith("/")), "/root/testdata/sf0.01")
    wanted = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = SparkSession.builder.master(f"local[{os.environ.get('CPUS', '4')}]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    signal.signal(signal.SIGALRM, _late)
    connection, sql = connect(sf_dir), entry.oracle_sql()
    for name, f in entry.queries().items():
        if wanted and name not in wanted:
            continue
        began = time.time()
        signal.alarm(int(os.environ.get("LIMIT", "60")))
        try:
            df = f(spark, sf_dir)
            wrong = differences(df, connection, sql[name]) if name in sql else [f"no SQL; {df.count()} rows"]
        except Exception as e:
            wrong = [f"{type(e).__name__}: {str(e)[:1500]}"]
        signal.alarm(0)
        print(f"{name}: {'equal' if not wrong else wrong} ({time.time() - began:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
