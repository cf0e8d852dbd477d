"""Python-backed operators must run when the package is not on the workers'
path (the driver may load __spark_entry__.py by file path from any folder)."""

import os
import subprocess
import sys
import tempfile

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("entry_mod", {entry!r})
mod = importlib.util.module_from_spec(spec); spec.loader.exec_module(mod)
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
qs = mod.queries()
for name in ["token_diff_rows", "batch_manifest"]:
    print(name, qs[name](spark, "/root/testdata/sf0.001").count())
spark.stop()
"""


def test_udf_queries_from_another_folder():
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    with tempfile.TemporaryDirectory() as cwd:
        out = subprocess.run([sys.executable, "-c", SCRIPT.format(entry=os.path.join(REPO, "__spark_entry__.py"))],
                             cwd=cwd, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-3000:]
    counts = dict(line.split() for line in out.stdout.strip().splitlines())
    assert int(counts["token_diff_rows"]) > 0 and int(counts["batch_manifest"]) > 0
