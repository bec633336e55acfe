"""Queries whose plans pass through Python workers run from any working directory."""

import os
import subprocess
import sys

SCRIPT = """
import importlib.util, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "2").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
spec = importlib.util.spec_from_file_location("entry", sys.argv[1])
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
found = entry.queries()
for name in sys.argv[2:]:
    print(name, found[name](spark, "/root/testdata/sf0.001").count())
"""


def test_queries_run_from_a_foreign_folder(tmp_path):
    entry = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    known = subprocess.run([sys.executable, "-c", f"import sys; sys.path.insert(0, {os.path.dirname(entry)!r}); "
                            "from outagelens.plans.registry import load_all; print(*load_all())"], capture_output=True, text=True, cwd=tmp_path)
    names = [n for p in ("a11", "t05", "w01_", "f10", "l04_") for n in known.stdout.split() if n.startswith(p)][:6]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, entry, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    rows = dict(line.split() for line in done.stdout.splitlines())
    assert sorted(rows) == sorted(names) and all(int(n) > 0 for n in rows.values())
