"""Registered queries against their SQL, their contracts' columns, and the pipeline's stages on the smallest tables."""

import os

import duckdb
import pytest

import corpus_pipeline
import __spark_entry__ as entry_points
from rollcall.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are not here")


def test_all_are_registered():
    names = entry_points.queries()
    assert "pipeline" in names and [n for n in range(1, 14) if not any(q.startswith(f"op{n}_") for q in names)] == []


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    result = con.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    df = QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(result.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["op1_personal_data", "op3_decontamination", "op4_url_filter", "op6_chat"])
def test_native_queries_run_no_python(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Join Cross"))


def test_pipeline_stages_keep_the_columns_and_filter(spark):
    from pyspark.sql import functions as F

    from rollcall.llm import decontaminate, jaccard, personal_data
    from rollcall.llm.common import stored

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out, left = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, out, FOLDER), "test")
        left.append((name, out))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
    quality, near, clean, masked, packed = (df for _, df in left)
    assert 0 < near.count() < quality.count() < docs.count()
    groups = jaccard.groups(quality, 80, 5)
    assert near.count() == groups.select("component_id").distinct().count()
    assert not decontaminate.report(clean, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).where("contaminated").count()
    assert clean.count() == masked.count()
    assert masked.where(F.col("text").rlike(personal_data.BASE["email"])).count() == 0
    assert packed.where("pack is not null").select("doc_id").distinct().count() == masked.where("text <> ''").count()
