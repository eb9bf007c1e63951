"""Compare registered queries with their SQL: ``python tests/check_oracle.py SF [KEY ...]``."""

from __future__ import annotations

import math
import os
import sys
import time
import traceback
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return db


def plain(value):
    """A value both engines give in the same form."""
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    return str(value) if type(value).__name__ == "Decimal" else value


def rows_of(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, db, sf_dir: str, key: str) -> str | None:
    """None when equal, else what differs."""
    got = entry.queries()[key](spark, sf_dir)
    names = got.columns
    mine = rows_of(names, got.collect())
    if key not in entry.oracle_sql():
        return None if mine else "no rows and no SQL"
    result = db.execute(entry.oracle_sql()[key])
    other_names = [d[0] for d in result.description]
    if sorted(names) != sorted(other_names):
        return f"columns {sorted(names)} and {sorted(other_names)}"
    theirs = rows_of(other_names, result.fetchall())
    if mine == theirs:
        return None if mine else "no rows on either side"
    return (
        f"{sum(mine.values())} and {sum(theirs.values())} rows; only here {list((mine - theirs).items())[:3]}; "
        f"only there {list((theirs - mine).items())[:3]}"
    )


def main() -> int:
    sf_dir = f"/root/testdata/{sys.argv[1]}"
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.driver.memory", "16g").config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db = connect(sf_dir)
    failed = 0
    for key in sys.argv[2:] or entry.queries():
        begun = time.time()
        try:
            difference = compare(spark, db, sf_dir, key)
        except Exception:
            difference = traceback.format_exc(limit=6)[-1800:]
        failed += difference is not None
        print(f"{'ok  ' if difference is None else 'FAIL'} {key} {time.time() - begun:.1f}s {difference or ''}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main() > 0)
