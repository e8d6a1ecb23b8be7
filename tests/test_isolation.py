"""Without the training-data subpackage the rest imports and keeps its queries."""

from __future__ import annotations

import shutil
import subprocess
import sys

import pytest

from tests.conftest import ROOT

_PROBE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(sum(n.startswith('op') for n in q), 'pipeline' in q, len(q) > 100)"


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_subpackage(tmp_path, left):
    for path in ("__spark_entry__.py", *left):
        shutil.copy(ROOT / path, tmp_path)
    shutil.copytree(ROOT / "stallwise", tmp_path / "stallwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", _PROBE], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120, check=False)
    assert done.stdout.split() == ["0", "False", "True"], done.stderr
