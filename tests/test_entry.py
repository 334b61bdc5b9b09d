import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data here")
def test_flagship(spark):
    rows = importlib.import_module("__spark_entry__").entry(spark)
    assert rows.columns == ["transcript_id", "para_no", "start_s", "end_s", "text"] and rows.count() > 0


def test_imports_without_the_optional_subpackage(tmp_path):
    shutil.copytree(ROOT / "tidecue", tmp_path / "tidecue", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'paragraphs' in q and not any(n.startswith('p7') for n in q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
