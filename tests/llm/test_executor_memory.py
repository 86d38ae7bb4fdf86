"""Executors of their own, as processes: what a stage leaves in their heaps goes before the next."""

import os
import subprocess
import sys
from pathlib import Path

import pyspark

ROOT = Path(__file__).resolve().parents[2]
RUN = """
import sys
import psutil
from pyspark.sql import SparkSession, functions as F
import corpus_pipeline
from pagelore.llm._common import table

sf_dir, tmp = sys.argv[1:]
conf = {"spark.master": "local-cluster[2,1,1024]", "spark.executor.memory": "1024m", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": f"file://{tmp}/shared", "spark.sql.warehouse.dir": f"{tmp}/warehouse"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
mb = lambda: [p.memory_info().rss >> 20 for p in psutil.Process().children(recursive=True) if "CoarseGrainedExecutorBackend" in " ".join(p.cmdline())]
docs = table(spark, sf_dir, "documents")
spark.range(0, 16, 1, 16).select(F.length(F.repeat(F.col("id").cast("string"), F.lit(150_000_000)))).collect()
grown = mb()
corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
print("MB", *grown, *mb())
spark.stop()
"""


def test_a_stage_begins_with_small_heaps(sf_dir, tmp_path):
    home = tmp_path / "home"  # executors work below Spark's home
    home.mkdir()
    for p in Path(pyspark.__file__).parent.iterdir():
        if p.name != "work":
            (home / p.name).symlink_to(p)
    env = {k: v for k, v in os.environ.items() if not k.startswith("PYSPARK_GATEWAY")} | {"SPARK_HOME": str(home), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "SPARK_LOCAL_DIRS": str(tmp_path / "local"), "PYTHONPATH": str(ROOT), "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", RUN, sf_dir, str(tmp_path)], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    mb = [int(x) for line in done.stdout.splitlines() if line.startswith("MB ") for x in line.split()[1:]]
    assert len(mb) == 4, done.stderr[-2000:]
    assert all(after < grown - 150 for grown, after in zip(mb[:2], mb[2:], strict=True)), mb
