"""bench.py prints exactly one JSON line with a value per report (the driver parses it)."""

import json
import os
import subprocess
import sys
import tempfile
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_RUNS="1", BENCH_CPUS="2",
               TMPDIR=tempfile.mkdtemp(prefix="uwlens-bench-test-", dir="/tmp"))
    out = subprocess.run([sys.executable, str(ROOT / "bench.py")], cwd=env["TMPDIR"], env=env,
                         capture_output=True, text=True, timeout=900)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = [line for line in out.stdout.splitlines() if line.strip()]
    assert len(lines) == 1, out.stdout
    result = json.loads(lines[0])
    assert result["unit"] == "sec" and result["value"] > 0 and len(result["queries"]) == 12
