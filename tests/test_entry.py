"""The driver's entry points, with and without the optional corpus operators."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_every_key_with_sql_is_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["a", "b", "shared", "score"]


def test_without_the_optional_parts(tmp_path):
    shutil.copytree(ROOT / "terrace", tmp_path / "terrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert not e.HAS_LLM and 'near_copies' in e.queries() and 'pipeline' not in e.queries() and e.oracle_sql(); import terrace.sources.files, terrace.streaming.journal"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_nothing_else_imports_the_optional_parts():
    for file in (ROOT / "terrace").rglob("*.py"):
        if "llm" not in file.parts:
            assert "terrace.llm" not in file.read_text(), file
