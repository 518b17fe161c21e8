"""The driver's entry: it runs, and it imports without the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as driver

FOLDER = Path("/root/testdata/sf0.001")
ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.skipif(not FOLDER.exists(), reason="the driver's tables are absent")
def test_entry_gives_rows(spark):
    assert driver.entry(spark).count() > 0


def test_each_sql_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_imports_without_corpus_operators():
    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') or k == 'pipeline' for k in e.queries()))"
    found = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True)
    n, any_corpus = found.stdout.split()
    assert int(n) > 40 and any_corpus == "False"
