"""The operators' task code and models reach executors that have no copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from newsloom.session import build_session
spark = build_session(master="local[4]", **{{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}})
for name, query in entry.queries().items():
    if name.startswith("op"):
        assert query(spark, "/root/testdata/sf0.001").count() > 0, name
print("SHIPPED")
"""


def test_runs_outside_the_repository(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT)],
        cwd=tmp_path,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
        capture_output=True,
        text=True,
        timeout=900,
    )
    assert "SHIPPED" in done.stdout, done.stderr[-3000:]
