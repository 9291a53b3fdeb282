"""Task failures (lost executors) do not change results: a separate process
with task retries runs the adaptation on input whose every task fails its
first attempt."""

import os
import subprocess
import sys

from conftest import SF_SMALL


def test_results_survive_failed_tasks():
    job = os.path.join(os.path.dirname(os.path.abspath(__file__)), "recovery_job.py")
    run = subprocess.run([sys.executable, job, SF_SMALL], capture_output=True, text=True, timeout=600)
    assert "SAME" in run.stdout, run.stdout[-2000:] + run.stderr[-2000:]
