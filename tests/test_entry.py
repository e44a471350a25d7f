"""The core queries do not depend on the packages of the others."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
WITHOUT = """
import sys
sys.path.insert(0, {root!r})
for name in {missing!r}:
    sys.modules[name] = None  # as if it were not installed
import __spark_entry__ as entry
queries, sql = entry.queries(), entry.oracle_sql()
print(len(queries), sum(n.startswith("op") for n in queries), "c2_overdue_by_date" in queries, set(sql) <= set(queries))
"""


@pytest.mark.parametrize("missing", [("public_tokenizers",), ("gapkit.llm",), ("corpus_pipeline",), ("tokenizers", "sentencepiece", "pyarrow.compute")])
def test_core_queries_are_there_without(missing):
    code = WITHOUT.format(root=str(ROOT), missing=missing)
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, _, core, paired = out.stdout.split()
    assert int(n) >= 160 and core == paired == "True"
