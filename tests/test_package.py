"""The package reaches Python workers wherever the driver was started."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = f"""
import sys
sys.path.insert(0, {REPO!r})
import __spark_entry__ as entry
from footfall.session import build_session
spark = build_session("elsewhere", "local[2]", 2)
print("rows", entry.queries()["rate_limit"](spark, "/root/testdata/sf0.001").count())
"""


def test_a_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows " in done.stdout and done.returncode == 0, done.stderr[-2000:]
