"""The entry without the subpackage of training-data operators, the pipeline, or both."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
TELL = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("gone", [[], ["corpus_pipeline.py"], ["tidewatch/llm"], ["corpus_pipeline.py", "tidewatch/llm"]])
def test_entry_imports_without(tmp_path, gone):
    kept = {"tidewatch/llm", "corpus_pipeline.py"} - set(gone)
    if any(not (ROOT / name).exists() for name in kept):
        pytest.skip("this checkout lacks them already")
    shutil.copytree(ROOT / "tidewatch", tmp_path / "tidewatch", ignore=shutil.ignore_patterns("__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    for name in gone:
        (shutil.rmtree if (tmp_path / name).is_dir() else Path.unlink)(tmp_path / name)
    said = subprocess.run([sys.executable, "-B", "-c", TELL], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{':'.join(p for p in sys.path if 'site-packages' in p or p.startswith('/opt'))}"}, capture_output=True, text=True, check=False)
    assert said.returncode == 0, said.stderr
    total, ops, pipeline = said.stdout.split()
    assert int(total) > 180 and (int(ops) > 0) == ("tidewatch/llm" not in gone) and pipeline == str(not gone)
