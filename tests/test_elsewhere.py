"""Task functions must run where the package is not importable, as on executors of a cluster."""

import os
import subprocess
import sys

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from askloom.session import build_session
from askloom.operators import retrieval
spark = build_session(master="local[2]", shuffle_partitions=2, **{"spark.ui.enabled": "false"})
c = spark.createDataFrame([(1, 1, [1.0, 0.0]), (1, 2, [0.0, 1.0])], "kb_id bigint, chunk_id bigint, vector array<double>")
q = spark.createDataFrame([(5, 1, [1.0, 0.1])], "q_id bigint, kb_id bigint, vector array<double>")
print("best", retrieval.vector_topk(q, c, 1).first().chunk_id)
"""


def test_tasks_do_not_import_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=150)
    assert "best 1" in done.stdout, done.stderr[-2000:]
