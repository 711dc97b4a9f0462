"""Scratch folders in sessions of their own: no folder named, and a folder without a scheme."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

PROGRAM = """
import sys
from tidemark.session import local_session
from tidemark.llm import common, mixing, warc
spark = local_session(2, "scratch", **dict(x.split("=", 1) for x in sys.argv[1:]))
df = spark.createDataFrame([(1, "a b c", "s"), (2, "d e", None)], "doc_id long, text string, source string")
assert mixing.plan(df).count() == 2
pages = spark.createDataFrame([(1, "u", "x" * 2000), (2, "v", "x" * 2000)], "page_id long, url string, html string")
members, folder = warc.archive(pages)
assert sorted(r.record_type for r in warc.read_archives(members, folder).collect()) == ["response", "revisit"]
spark.range(3).checkpoint().count()
print("FOLDER", common.scratch_path(spark, "x"))
"""


@pytest.mark.parametrize("named", [False, True])
def test_folder(tmp_path, named):
    (tmp_path / "conf").mkdir()
    root = str(Path(__file__).resolve().parents[2])
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path / "conf"), "PYTHONPATH": root, "TMPDIR": str(tmp_path)}
    env.pop("PYSPARK_SUBMIT_ARGS", None)
    run = subprocess.run([sys.executable, "-c", PROGRAM, *([f"spark.checkpoint.dir={tmp_path}/shared"] if named else [])], env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-3000:]
    assert f"FOLDER file://{tmp_path}/{'shared' if named else 'tidemark-shared'}/tidemark/" in run.stdout
