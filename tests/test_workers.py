"""Task functions reach Python workers that were started elsewhere."""

import os
import pathlib
import subprocess
import sys

from panelspark.session import configure

REPO = str(pathlib.Path(__file__).resolve().parents[1])
CODE = """
import sys
sys.path.insert(0, {repo!r})
import __spark_entry__ as entry
from panelspark.session import build_session
spark = build_session("elsewhere", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false"}})
for name in ("event_study", "absorb_two_way"):
    assert entry.queries()[name](spark, {sf!r}).count() > 0
print("reached")
"""


def test_queries_run_from_an_empty_folder(sf, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(repo=REPO, sf=sf)
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=280)
    assert "reached" in done.stdout, done.stderr[-2000:]


def test_what_a_task_reads_is_bounded(spark):
    """Sorts hold what a task reads, so a task must not get the whole default of 64 or 128 MB; named values stay."""
    size, split = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
    fresh = spark.newSession()
    assert configure(fresh).conf.get(size) == fresh.conf.get(split) == "16m"
    named = spark.newSession()
    named.conf.set(size, "8m")
    assert configure(named).conf.get(size) == "8m"
