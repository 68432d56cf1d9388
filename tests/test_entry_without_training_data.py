"""The entry point works where the training-data folder and its pipeline are absent."""

import os
import shutil
import subprocess
import sys

from conftest import ROOT


def test_entry_imports_without_the_folder(tmp_path):
    keep = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(os.path.join(ROOT, "lodgelake"), tmp_path / "lodgelake", ignore=keep)
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n[:2] == 'op' and n[2].isdigit() for n in q), 'pipeline' in q, len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True)
    n, ops, pipeline, sql = out.stdout.split()
    assert int(n) > 100 and (ops, pipeline) == ("False", "False") and int(sql) > 100
