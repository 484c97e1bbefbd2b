"""python tests/check.py [prefix ...]  - compare registered queries with their SQL, with timings."""

import os
import signal
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as E
from compare import difference, duck
from strandline.session import build_session

sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
spark = build_session(master="local[8]", shuffle_partitions=8, driver_memory="8g")
spark.sparkContext.setLogLevel("ERROR")
con = duck(sf)
queries, oracles = E.queries(), E.oracle_sql()
names = [n for n in queries if not sys.argv[1:] or any(n.startswith(p) for p in sys.argv[1:])]
fails = 0


def stop(*_):
    spark.sparkContext.cancelAllJobs()
    raise TimeoutError('query too slow')


signal.signal(signal.SIGALRM, stop)
limit = int(os.environ.get('LIMIT', '45'))
for n in names:
    t = time.time()
    signal.alarm(limit)
    try:
        df = queries[n](spark, sf)
        if n in oracles:
            msg = difference(df, con, oracles[n])
        else:
            rows = df.collect()
            msg = None if rows else "no rows"
            if os.environ.get("SHOW"):
                print("   ", rows[:3])
    except Exception as e:
        msg = f"{type(e).__name__}: {str(e)[:600]}"
    signal.alarm(0)
    fails += msg is not None
    tag = "R" if n not in oracles else "O"
    print(f"{'ok  ' if msg is None else 'FAIL'} {tag} {n} {time.time() - t:.1f}s" + (f"  {msg}" if msg else ""), flush=True)
print(f"{len(names) - fails}/{len(names)} ok")
spark.stop()
