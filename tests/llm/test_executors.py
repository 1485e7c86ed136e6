"""Executors without the package: started elsewhere, with nothing on the Python path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (
    SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "3g").getOrCreate()
)
import __spark_entry__ as entry
found = entry.queries()
for name in {names!r}:
    rows = found[name](spark, "/root/testdata/sf0.001").count()
    assert rows > 0, name
    print("done", name, flush=True)
spark.stop()
"""
NAMES = [
    "op1_mixing", "op2_sharding", "op3_bpe", "op4_ann", "op5_toxicity", "op6_quality", "op7_quality_rules",
    "op8_langid", "op9_simhash", "op10_suffix_dedup", "op11_resampling", "op12_license_scan",
    "op13_periodic_runs", "pipeline",
]


def test_every_query_runs_where_the_package_is_not_installed(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=ROOT, names=NAMES)
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    done = [line.split()[1] for line in run.stdout.splitlines() if line.startswith("done ")]
    assert done == NAMES, run.stderr[-3000:]
