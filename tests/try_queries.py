"""Run registered queries against DuckDB: python tests/try_queries.py [sf] [prefix ...]"""

import sys
import time
import traceback

sys.path.insert(0, "/root/repo")
sys.path.insert(0, "/root/repo/tests")

import __spark_entry__ as entry  # noqa: E402
from compare import compare, connect  # noqa: E402

from granary.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
prefixes = sys.argv[2:]
spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
folder = f"/root/testdata/sf{sf}"
con = connect(folder)
qs, sqls = entry.queries(), entry.oracle_sql()
bad = 0
for name, run in qs.items():
    if prefixes and not any(name == p or name.startswith(p + "_") for p in prefixes):
        continue
    t0 = time.time()
    try:
        df = run(spark, folder)
        if name in sqls:
            msg = compare(df, sqls[name], con)
        else:
            rows = df.collect()
            msg = f"no-sql rows={len(rows)} {str(rows[0])[:100] if rows else ''}"
    except Exception as e:
        msg = "ERROR " + str(e)[:600]
        if "--tb" in sys.argv:
            traceback.print_exc()
    ok = msg == "" or msg.startswith("no-sql")
    bad += not ok
    print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - t0:.1f}s {msg}"[:900], flush=True)
print("bad:", bad)
