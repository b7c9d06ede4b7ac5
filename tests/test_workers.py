"""Python workers must not need the package on their own path."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys; sys.path.insert(0, {ROOT!r})
from __spark_entry__ import queries
from matchspark.session import local_session
spark = local_session(2, "2g")
for name in ("batch_match_topk", "batch_match_tiled", "hash_embedding", "vector_score_topk"):
    assert queries()[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("fine")
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-2000:]
