"""A session without any preset configuration gets a checkpoint folder of its own."""

import os
import subprocess
import sys

CODE = """
from stockroom.session import ensure_checkpoint_dir, local_session, materialize
s = local_session(cores=1)
first = ensure_checkpoint_dir(s)
assert first and ensure_checkpoint_dir(s) == ensure_checkpoint_dir(s)
assert materialize(s.range(3), "t").count() == 3
assert s.range(2).checkpoint().count() == 2
s.stop()
"""


def test_session_on_an_empty_conf_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
