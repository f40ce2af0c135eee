"""The registered queries and the pipeline over the smallest tables."""

import os
import subprocess
import sys

import corpus_pipeline
from evenhand.llm.queries import QUERIES
from tests.llm.samples import SF

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_every_operator_is_registered_once():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES)
    assert numbers == list(range(1, 14))


def test_pipeline_runs_and_keeps_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        after = docs.count()
        assert 0 < after <= before, name
        before = after
        assert docs.columns == columns or name == corpus_pipeline.STAGES[-1][0]
    assert corpus_pipeline.run(spark, SF).count() == before


def test_the_library_stands_without_these_folders(tmp_path):
    code = ("import sys, importlib.abc\n"
            "class Gone(importlib.abc.MetaPathFinder):\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name in ('corpus_pipeline', 'evenhand.llm'):\n"
            "            raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "names = e.queries()\n"
            "assert names and not any(n.startswith('op1_') or n == 'pipeline' for n in names)\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
