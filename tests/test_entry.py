"""The entry points without the corpus operators: what is left imports and runs."""

import pathlib
import shutil
import subprocess
import sys

import pytest

from workload import all_oracles, all_queries

ROOT = pathlib.Path(__file__).parents[1]


@pytest.mark.parametrize("without", [["tallyward/llm"], ["tallyward/llm", "corpus_pipeline.py"]])
def test_queries_without_the_corpus_operators(folder, without):
    kept = shutil.ignore_patterns("llm", ".git", "__pycache__", *[w for w in without if w.endswith(".py")])
    shutil.copytree(ROOT, f"{folder}/copy", ignore=kept)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    said = subprocess.run([sys.executable, "-c", code], cwd=f"{folder}/copy", capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(all_queries())), str(len(all_oracles()))]
