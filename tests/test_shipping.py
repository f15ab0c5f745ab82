"""Task-side code reaches executors that have no copy of the package."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
from newsloom.plans.rounds import rechunk_with_model
from newsloom.operators.summarise import model_logits
from newsloom.session import build_session
from newsloom.sources.tables import articles
spark = build_session(master="local[4]", **{{"spark.ui.enabled": "false"}})
folder = "/root/testdata/sf0.001"
for name in ("rougeL", "rouge_stemmed", "rouge_means", "experiment_export", "template_bodies"):
    assert entry.queries()[name](spark, folder).count() > 0, name
rows = articles(spark, folder).select("doc_id", "article_body")
assert rechunk_with_model(rows, ["doc_id"], lambda: lambda texts: [t[:40] for t in texts]).count() > 0
assert model_logits(rows, ["doc_id"], "article_body", lambda: lambda t: [(0, 1)] * len(t)).count() > 0
print("SHIPPED")
"""


def test_runs_outside_the_repository(tmp_path):
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(root=ROOT)],
        cwd=tmp_path,
        env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"},
        capture_output=True,
        text=True,
        timeout=300,
    )
    assert "SHIPPED" in done.stdout, done.stderr[-3000:]
