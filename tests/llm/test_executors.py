"""Worker code runs where the package is not installed: only the driver can import it."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from quizlens.session import build_session
spark = build_session("apart", "local[2]", **{{"spark.sql.shuffle.partitions": "2", "spark.ui.showConsoleProgress": "false"}})
import __spark_entry__ as contract
for name in {names!r}:
    contract.queries()[name](spark, {data!r}).count()
    print("done", name)
"""
NAMES = ["op1_language_id", "op6_pieces", "op10_secret_scan", "op12_merkle_manifest", "op13_phrases"]


def test_without_the_package_on_executors(data, tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    tokenizers = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and not p.startswith(REPO)]
    if tokenizers:
        env["PYTHONPATH"] = os.pathsep.join(tokenizers)
    script = SCRIPT.format(repo=REPO, names=NAMES, data=data)
    run = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert [line.split()[1] for line in run.stdout.splitlines() if line.startswith("done")] == NAMES, run.stderr[-3000:]
