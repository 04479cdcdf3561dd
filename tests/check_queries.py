"""Command-line check: python tests/check_queries.py [sf dir] [name prefix...]"""

import os
import sys
import threading
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402

from tastemark.plans.catalog import ORACLES, QUERIES  # noqa: E402
from tastemark.session import get_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
spark = get_session(cores=8)
spark.sparkContext.setLogLevel("ERROR")
con = connect(sf)
failed = 0
for name, fn in QUERIES.items():
    if wanted and not any(name.startswith(w) for w in wanted):
        continue
    start = time.time()
    timer = threading.Timer(float(os.environ.get("QUERY_SECONDS", "90")), spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        df = fn(spark, sf)
        result = compare(df, con, ORACLES[name]) if name in ORACLES else f"rows only: {df.count()}"
    except Exception as e:  # noqa: BLE001
        result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
    timer.cancel()
    ok = result is None or result.startswith("rows only")
    failed += not ok
    print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {result or ''}", flush=True)
print("failed", failed)
