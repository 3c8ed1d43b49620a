"""Executors need no copy of the package: workers that cannot import it run every trained operator."""
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import os, sys
root, work = sys.argv[1:]
os.environ["TIDEWRIGHT_TEST_DIR"] = work
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "3")
         .config("spark.python.use.daemon", "true").getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
sys.path.insert(0, root)  # after the JVM has started: only the driver's path
def visible(batches):
    import importlib.util
    for b in batches:
        b["id"] = int(importlib.util.find_spec("tidewright") is not None)
        yield b
assert spark.range(1).mapInPandas(visible, "id long").first()[0] == 0
from tidewright.llm import queries
sf = "/root/testdata/sf0.001"
for name in ("op1_toxicity", "op4_sentencepiece", "op5_learned_partitions", "op7_url_filter", "op10_quality", "op11_prefix_trie", "op13_token_links"):
    queries.queries()[name](spark, sf).write.format("noop").mode("overwrite").save()
print("all ran")
"""


def test_workers_without_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_ENV_LOADED")} | {"PYTHONSAFEPATH": "1"}
    (tmp_path / "script.py").write_text(SCRIPT)
    done = subprocess.run([sys.executable, str(tmp_path / "script.py"), ROOT, str(tmp_path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all ran" in done.stdout, done.stderr[-3000:]
