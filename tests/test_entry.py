"""The contract holds with and without the training-data operators."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__

CODE = """
import sys
sys.modules["skein.llm"] = None
sys.modules["corpus_pipeline"] = None
import __spark_entry__ as e
assert e.queries() and not any(n.startswith("op") or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_the_subpackage():
    subprocess.run([sys.executable, "-c", CODE], check=True, cwd=Path(__spark_entry__.__file__).parent)
