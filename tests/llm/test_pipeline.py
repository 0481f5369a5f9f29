"""The pipeline's stages, and the repository without them."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import edges
import pytest

import corpus_pipeline
from nuqta.llm import bwt_dedup, kneser_ney, language_id, near_dup, packing
from nuqta.llm.common import written

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).parents[2]
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@tables
def test_each_stage_does_what_its_operator_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "near_dedup", "suffix_dedup", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and ids(out) <= ids(docs)
        if name == "language_id":
            wanted = language_id.identify(docs, language_id.train(docs)).where("accepted")
            assert ids(out) == ids(wanted)
        elif name == "quality":
            assert ids(out) == ids(kneser_ney.assess(docs, kneser_ney.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))).where("accepted"))
            bad = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0")
            assert len(ids(out) & ids(bad)) <= 0.2 * len(ids(docs) & ids(bad))
        elif name == "near_dedup":
            assert ids(out) == ids(docs) - ids(near_dup.near_duplicates(docs))
            assert near_dup.near_duplicates(out).count() == 0
        else:
            assert bwt_dedup.repeated_passages(out).count() <= bwt_dedup.repeated_passages(docs).count()
        docs = out
    name, stage = corpus_pipeline.STAGES[-1]
    assert sorted(map(tuple, stage(spark, docs, SF).collect())) == sorted(map(tuple, packing.pack(docs).collect()))


@tables
def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_at_the_edges(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (edges.ROWS, []):
        docs = edges.docs(spark, rows)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = written(stage(spark, docs, str(tmp_path)), "edge")
            assert docs.columns == edges.docs(spark, []).columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= 0


def test_the_rest_stands_alone(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; assert e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": str(tmp_path / "repo")}, check=True)
