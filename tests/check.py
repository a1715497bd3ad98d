"""Run queries against their SQL twins: ``python tests/check.py [sf] [name ...]``."""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from movara.plans.catalog import ORACLES, QUERIES  # noqa: E402
from tests.oracle import compare, connect  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("0.") else "0.01"
    names = [n for n in QUERIES if not args or any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in args)]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "10g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = []
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            problems = compare(df.columns, rows, con, ORACLES[name]) if name in ORACLES else []
            note = f"{len(rows)} rows" + ("" if name in ORACLES else " (no SQL)")
        except Exception as error:  # noqa: BLE001
            problems, note, spent = [str(error)[:1500]], "error", 0.0
        status = "FAIL" if problems else "ok"
        print(f"{status:4} {name:24} {spent:6.2f}s +{time.time() - start - spent:5.2f}s {note}", flush=True)
        for line in problems:
            print("     ", line, flush=True)
        if problems:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} ok", failed)
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
