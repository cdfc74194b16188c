"""Without the training-data subpackage the rest imports and runs."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_subpackage(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "parley", tmp_path / "parley", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for pipeline in (True, False):
        if not pipeline:
            (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)
        code = "import __spark_entry__ as e; q = e.queries(); assert 'session_report' in q and 'pipeline' not in q and not [k for k in q if k.startswith('op')]; assert set(e.oracle_sql()) <= set(q)"
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_nothing_else_imports_the_subpackage():
    for path in (ROOT / "parley").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT / "parley").parts:
            assert "parley.llm" not in path.read_text() and "from .llm" not in path.read_text(), path
