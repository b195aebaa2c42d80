"""The entry points with and without the operators for training data."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
_SAYS = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"


@pytest.mark.parametrize("gone", [["tessera/llm"], ["tessera/llm", "corpus_pipeline.py"]])
def test_entry_without_the_folder(tmp_path, gone):
    for name in ("tessera", "__spark_entry__.py", "corpus_pipeline.py"):
        own = ROOT / name
        if own.is_dir():
            shutil.copytree(own, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif own.exists():
            shutil.copy(own, tmp_path / name)
    for name in gone:
        own = tmp_path / name
        if own.is_dir():
            shutil.rmtree(own)
        elif own.exists():
            own.unlink()
    out = subprocess.run([sys.executable, "-c", _SAYS], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, with_sql, any_llm = out.stdout.split()
    assert int(n) >= int(with_sql) > 60 and any_llm == "False"
