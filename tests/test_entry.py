"""The entry without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
COUNT = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), any(n.startswith('op1_') for n in q), 'pipeline' in q)"


@pytest.mark.parametrize("missing", ["zstandard", "tokenizers", "public_tokenizers", "pagemill.llm"])
def test_library_queries_stay_when_a_module_is_missing(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; {COUNT}"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    count, operators, pipeline = out.stdout.split()[-3:]
    # Tokenizers are imported where they are used.
    assert int(count) >= 101 and pipeline == operators and (missing == "tokenizers" or operators == "False")
