import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_a_broken_operator_fails_loudly():
    code = "import sys; sys.modules['kinloom.llm.queries'] = None; import __spark_entry__"
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert run.returncode and ("ImportError" in run.stderr or "ModuleNotFoundError" in run.stderr)
