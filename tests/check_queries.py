"""Run registered queries next to their SQL twins: ``python tests/check_queries.py [folder] [name part ...]``."""

import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tests import oracle
from ticketloom.plans import catalogue
from ticketloom.session import build_session

folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
wanted = sys.argv[2:]
modules = [w[1:] for w in wanted if w.startswith('@')]
wanted = [w for w in wanted if not w.startswith('@')]
settings = {"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"}
settings["spark.checkpoint.dir"] = tempfile.mkdtemp(prefix="ticketloom-")
spark = build_session("check", "local[8]", **settings)
spark.sparkContext.setLogLevel("ERROR")
con = oracle.connect(folder)
bad = 0
for name, q in catalogue.all_queries().items():
    if modules and not any(m in q.run.__module__ for m in modules):
        continue
    if wanted and not any(w in name for w in wanted):
        continue
    start = time.time()
    try:
        df = q.run(spark, folder)
        if q.sql:
            t1 = time.time()
            problem = oracle.difference(df, con, q.sql)
            note = f"{df.count() if os.environ.get('ROWS') else ''}"
        else:
            problem, note = None, f"rows only: {df.count()} {df.dtypes}"
    except Exception as error:
        problem, note = f"{type(error).__name__}: {str(error)[:700]}", ""
        if os.environ.get("TRACE"):
            traceback.print_exc()
    bad += problem is not None
    print(f"{'FAIL' if problem else 'ok  '} {name:38s} {time.time() - start:6.2f}s {problem or note}", flush=True)
print("failures:", bad)
