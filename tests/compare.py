"""Run registered queries and their SQL twins and compare whole results.

Usage: python tests/compare.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TESTDATA = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float) and value == 0:
        return 0.0
    if isinstance(value, float) and value != value:
        return "NaN"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(plain(v) for v in value.values())
    return value


def normalised(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, sf_dir, run, sql):
    """None when both agree, else a short description."""
    df = run(spark, sf_dir)
    columns = df.columns
    ours = normalised(columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    kinds = {d[0]: str(d[1]) for d in cursor.description}
    theirs = normalised(names, cursor.fetchall())
    if sorted(columns) != sorted(names):
        return f"columns {sorted(columns)} against {sorted(names)}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    wrong = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(ours)} rows differ, first {wrong[0]}"
    odd = [c for c in names if "HUGEINT" in kinds[c] or "DECIMAL" in kinds[c]]
    return f"SQL types {[(c, kinds[c]) for c in odd]}" if odd else None


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main():
    import __spark_entry__ as entry

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = tuple(sys.argv[2:])
    sf_dir = f"{TESTDATA}/sf{sf}"
    spark, con = session(), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, run in queries.items():
        if wanted and not name.startswith(wanted):
            continue
        begun = time.perf_counter()
        try:
            if name in oracles:
                problem = differences(spark, con, sf_dir, run, oracles[name])
            else:
                problem = None if len(run(spark, sf_dir).collect()) else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        kind = "sql" if name in oracles else "rows"
        bad += problem is not None
        print(f"{time.perf_counter() - begun:6.2f}s {kind:4} {name}: {problem or 'ok'}", flush=True)
        spark.catalog.clearCache()
    print("bad:", bad)


if __name__ == "__main__":
    main()
