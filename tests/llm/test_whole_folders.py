"""What queries and the pipeline leave in the shared folder."""

import pytest

import corpus_pipeline
from proofmill.llm import queries
from proofmill.llm.shared import shared_dir

SF = "/root/testdata/sf0.001"


def folders(spark):
    at = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return {s.getPath().getName() for s in fs.listStatus(at)}


@pytest.mark.parametrize("name", ["op2_perplexity", "op3_jaccard_join", "op7_surrogates", "op11_neighbours"])
def test_query_leaves_what_its_result_reads(spark, name):
    before = folders(spark)
    result = queries.queries()[name](spark, SF)
    left = folders(spark) - before
    assert left <= {f.rsplit("/", 2)[-2] for f in result.inputFiles()} and len(left) <= 4
    assert result.count() > 0


def test_pipeline_leaves_its_result(spark):
    before = folders(spark)
    result = corpus_pipeline.run(spark, SF)
    assert len(folders(spark) - before) == 1 and result.count() > 0


def test_token_files_outlive_the_query(spark):
    """Their folder is in no plan, as tasks open the files by path."""
    before = folders(spark)
    result = queries.queries()["op1_token_files"](spark, SF)
    assert len(folders(spark) - before) == 1
    assert result.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
