"""Run registered queries and their SQL twins side by side and report differences."""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple, dict)):
        return ("nested", repr(value))
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple(str(x) for x in r))


def compare(df, con, sql) -> str | None:
    """None when equal, otherwise a short description of the first difference."""
    left_cols, left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    right_cols, right = rows_of([d[0] for d in res.description], res.fetchall())
    if left_cols != right_cols:
        return f"columns {left_cols} vs {right_cols}"
    if not left:
        return "no rows"
    if len(left) != len(right):
        only = [r for r in left if r not in set(right)][:2], [r for r in right if r not in set(left)][:2]
        return f"rows {len(left)} vs {len(right)}; only left/right {only}"
    for a, b in zip(left, right):
        for name, x, y in zip(left_cols, a, b):
            if type(x) is not type(y) or x != y:
                return f"{name}: {x!r} vs {y!r} in {a} / {b}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from evalspark.session import get_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark = get_session(
        "oracle", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
                                 "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name.split("_")[0] == w or name.startswith(w + "_") or name == w or (len(w) == 1 and name[0] == w) for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name in oracles:
                problem = compare(df, con, oracles[name])
                rows = ""
            else:
                n = df.count()
                problem, rows = (None if n else "no rows"), f" rows-only {n}"
        except Exception as e:  # report and go on with the next query
            problem, rows = f"{type(e).__name__}: {str(e)[:700]}", ""
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{rows} {(problem or '')[:900]}", flush=True)
    print(f"{failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
