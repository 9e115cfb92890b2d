"""Run registered queries against their SQL twins: python tools/compare.py [folder] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import threading
import time
from datetime import date, datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

from ledgerloom.registry import QUERIES, SQL  # noqa: E402
from ledgerloom.session import drop_intermediates, local_session  # noqa: E402

LIMIT = float(os.environ.get("COMPARE_LIMIT", "60"))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def plain(value):
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return f"{value + 0.0:.9g}"
    if isinstance(value, int):
        return f"{value}"
    if isinstance(value, datetime) and value.time() == datetime.min.time():
        return str(value.date())
    if isinstance(value, date):
        return str(value)
    return "NULL" if value is None else str(value)


def number_like(kind: str) -> str:
    kind = kind.lower()
    for group, names in {"int": ("bigint", "int", "integer", "hugeint", "long", "smallint", "tinyint"), "float": ("double", "float"),
                         "text": ("string", "varchar"), "bool": ("boolean",)}.items():
        if kind in names:
            return group
    return "float" if kind.startswith("decimal") else kind


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    start = time.time()
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    kinds = dict(df.dtypes)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    took = time.time() - start
    if name not in SQL:
        return True, f"rows only: {len(rows)} rows, {took:.1f}s"
    result = con.execute(SQL[name])
    names = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    if sorted(names) != columns:
        return False, f"columns differ: {columns} / {sorted(names)}"
    order = [names.index(c) for c in columns]
    want = sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    odd = [f"{c}:{kinds[c]}/{types[c]}" for c in columns if number_like(kinds[c]) != number_like(types[c])]
    note = f" TYPES {odd}" if odd else ""
    if rows == want:
        return True, f"ok {len(rows)} rows, {took:.1f}s{note}"
    left, right = set(rows) - set(want), set(want) - set(rows)
    return False, (f"rows {len(rows)}/{len(want)}, only spark {len(left)}, only sql {len(right)}{note}\n      {columns}\n"
                   f"      spark {sorted(left)[:3]}\n      sql   {sorted(right)[:3]}")


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    shared = os.environ.get("COMPARE_SHARED_DIR", os.path.join(os.getcwd(), "spark-warehouse", "shared"))
    spark = local_session(os.environ.get("COMPARE_CPUS", "8"), **{"spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    bad = []
    for name in names:
        guard = threading.Timer(LIMIT, spark.sparkContext.cancelAllJobs)
        guard.start()
        try:
            good, note = compare(spark, con, folder, name)
        except Exception as error:  # noqa: BLE001 - report and go on
            good, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        guard.cancel()
        if not good:
            bad.append(name)
        print(f"{'    ' if good else 'BAD '}{name}: {note}", flush=True)
    print(f"{len(names)} queries, {len(bad)} bad: {' '.join(bad)}")
    drop_intermediates(spark)
    spark.stop()


if __name__ == "__main__":
    main()
