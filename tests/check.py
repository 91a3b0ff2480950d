"""python tests/check.py [key-prefix ...] - compare queries with their oracles at $SF."""
import os, sys, time, traceback
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from metasift.session import local_session
from metasift.plans import load_all
from tests.harness import TIMES, compare, duck

sf = os.environ.get("SF", "/root/testdata/sf0.01")
spark = local_session(8)
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf)
entries = load_all()
want = sys.argv[1:]
bad = 0
for key, e in entries.items():
    if want and not any(key.startswith(w) or e.ident == w or (w.endswith("*") and e.ident.startswith(w[:-1])) for w in want):
        continue
    t = time.time()
    try:
        err = compare(spark, con, e, sf)
    except Exception as ex:
        err = "EXC " + str(ex)[:700]
        if os.environ.get("TB"): traceback.print_exc()
    if err:
        bad += 1
        print(f"FAIL {e.ident} {key} {time.time()-t:.1f}s {err}", flush=True)
    elif os.environ.get("V"):
        print(f"ok   {e.ident} {key} spark {TIMES.get(key,0):.1f}s total {time.time()-t:.1f}s", flush=True)
print("failures", bad)
