"""The driver's entry with and without what the operators on training data need."""

import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
for name in {names!r}:
    sys.modules[name] = None
import __spark_entry__ as e
assert "feature_matrix" in e.queries() and "pipeline" not in e.queries() and not [n for n in e.queries() if n.startswith("op")]
assert set(e.oracle_sql()) <= set(e.queries())
"""


@pytest.mark.parametrize("names", [["tokenizers"], ["public_tokenizers"], ["tideline.llm"], ["corpus_pipeline"]])
def test_entry_without_the_training_part(names):
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", SCRIPT.format(names=names)], cwd=HERE, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
