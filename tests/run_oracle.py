"""Run every registered query against its DuckDB oracle and print a report.

python tests/run_oracle.py [sf_dir] [key ...]
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from storeflow.session import local_session  # noqa: E402
from tests.oracle_harness import compare, duck  # noqa: E402


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark = local_session(8)
    con = duck(sf)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in sqls:
                res = compare(df, sqls[name], con)
            else:
                res = {"ok": True, "rows_spark": df.count(), "no_oracle": True}
        except Exception as e:  # noqa: BLE001
            res = {"ok": False, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        res["sec"] = round(time.time() - t, 2)
        bad += not res["ok"]
        print(name, json.dumps(res, default=str), flush=True)
    print(f"FAILED {bad} of {len(qs)}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
