"""The driver contract: registry shape, and a sample of queries beside SQL."""

import os
import re
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry
from compare import compare, duck

FOLDER = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    # Training-data queries go partly beyond SQL; their own tests hold them.
    own = {q for q in entry.queries() if q != "pipeline" and not re.match(r"op\d+_", q)}
    assert own <= set(entry.oracle_sql()) <= set(entry.queries())
    assert len(own) > 100


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
@pytest.mark.parametrize(
    "name",
    ["view_sort_page", "normalize_cells", "infer_schema", "json_table", "request_audit", "source_states", "rebuild_table", "render_rows"],
)
def test_sample_against_sql(spark, name):
    ok, note = compare(spark, duck(FOLDER), FOLDER, entry.queries()[name], entry.oracle_sql()[name])
    assert ok, note


LIST = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), sorted(set(q) ^ set(s)), any(n.startswith('op') for n in q))"


@pytest.mark.parametrize("gone", [("gridpress/llm", "tests/llm", "corpus_pipeline.py"), ("gridpress/llm", "tests/llm"), ()])
def test_registry_without_the_training_package(tmp_path, gone):
    """The other queries stay listed when the folders, or a library they need, are missing."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = tmp_path / "repo"
    away = {os.path.join(root, g) for g in gone} | {os.path.join(root, ".git")}
    shutil.copytree(root, copy, ignore=lambda d, names: [n for n in names if os.path.join(d, n) in away or n == "__pycache__"])
    if not gone:
        (copy / "ahocorasick.py").write_text("raise ImportError('not installed')\n")
    run = subprocess.run([sys.executable, "-c", LIST], cwd=copy, capture_output=True, text=True, check=True)
    own = [q for q in entry.queries() if q != "pipeline" and not re.match(r"op\d+_", q)]
    assert run.stdout.split() == [str(len(own)), "[]", "False"], run.stderr
