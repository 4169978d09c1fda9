"""The entry module with and without its optional parts."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("gone", [["tessera/llm", "tests/llm"], ["tessera/llm", "tests/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_entry_works_where_optional_parts_are_deleted(tmp_path, gone):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json"))
    for name in gone:
        path = copy / name
        shutil.rmtree(path, ignore_errors=True) if path.is_dir() else path.unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), 'pipeline' in e.queries(), any(n.startswith('op') for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    queries, sql, pipeline, operators = said.stdout.split()
    assert int(queries) >= 30 and int(sql) >= 30 and pipeline == "False"
    assert operators == str(not any("llm" in g for g in gone) and (copy / "tessera/llm").exists())


def test_parts_of_another_copy_on_the_path_are_not_taken(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json"))
    (copy / "corpus_pipeline.py").unlink(missing_ok=True)
    code = "import __spark_entry__ as e; print('pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert said.stdout.strip() == "False", said.stderr


def test_errors_inside_installed_parts_are_not_hidden(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", "*.json"))
    (copy / "tessera/llm").mkdir(exist_ok=True)
    (copy / "tessera/llm/__init__.py").write_text("")
    (copy / "tessera/llm/registry.py").write_text("import no_such_module\n")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=copy, capture_output=True, text=True, timeout=120)
    assert said.returncode != 0 and "no_such_module" in said.stderr
