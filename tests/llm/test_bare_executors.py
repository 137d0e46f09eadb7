"""Every operator on workers that cannot import the library."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local-cluster[1,2,2048]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    .config("spark.executor.memory", "2g").config("spark.driver.memory", "2g").config("spark.checkpoint.dir", {scratch!r}).config("spark.driver.host", "127.0.0.1").getOrCreate())
def importable(batches):
    try:
        import gridmat
        found = True
    except ImportError:
        found = False
    import pyarrow as pa
    for batch in batches:
        yield pa.RecordBatch.from_pydict({{"x": [found] * batch.num_rows}})
assert not any(r.x for r in spark.range(4).mapInArrow(importable, "x boolean").collect()), "workers can import the library"
from gridmat.llm.queries import QUERIES
for name in {names!r}:
    rows = QUERIES[name](spark, "/root/testdata/sf0.001").count()
    print("ROWS", name, rows, flush=True)
"""
NAMES = ["op1_dom_trees", "op4_viterbi_language", "op5_perplexity_rules", "op8_soft_mix", "op10_random_indexing", "op11_index_warc", "op12_lyndon_runs"]


@pytest.mark.skipif(not os.path.exists("/opt/tokenizers"), reason="needs the box's files")
def test_workers_without_the_package(tmp_path):
    """A worker that runs elsewhere has neither the driver's path nor its folder."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(root=ROOT, scratch=str(tmp_path / "shared"), names=NAMES)
    done = subprocess.run([sys.executable, "-c", script], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=900)
    counts = dict(line.split()[1:] for line in done.stdout.splitlines() if line.startswith("ROWS"))
    assert list(counts) == NAMES and all(int(n) > 0 for n in counts.values()), done.stderr[-3000:]
