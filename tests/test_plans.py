"""Shapes of physical plans: shuffles, pushdown and single evaluation."""

import re

from pyspark.sql import functions as F

from hazlake.operators import rollup, similar
from hazlake.operators.quality import deduplicate
from hazlake.plans.analysis import scored_history
from hazlake.plans.derived import project
from hazlake.plans.intake import parquet_scan

SF = "/root/testdata/sf0.001"


def plan(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = df._jdf.queryExecution().explainString(mode)
    return text.split("\n\n\n")[0], text


def shuffles(df):
    return len(re.findall(r"\bExchange \(", plan(df)[0]))


def history(spark):
    return scored_history(project(spark.read.parquet(f"{SF}/documents.parquet"), "raw_reports"))


def test_scoring_does_not_shuffle(spark):
    assert shuffles(history(spark)) == 0


def test_filter_on_tier_does_not_repeat_the_rules(spark):
    plain = plan(history(spark))[1].count("440v")
    assert plan(history(spark).filter("tier = 'HIGH'"))[1].count("440v") == plain
    assert plan(history(spark).select(F.explode("precursors")))[1].count("440v") == plain


def test_rollup_shuffles_once(spark):
    top, _ = plan(rollup.location_rollup(history(spark)))
    assert top.count("Exchange (") == 1 and top.count("HashAggregate") == 2
    assert "Window" not in top and top.count("ArrowEvalPython (") == 1


def test_dedup_merges_before_its_shuffle(spark):
    frame = spark.range(10).selectExpr("'t' AS cleaned_text", "1 AS severity_rank", "'s' AS source_dataset", "id AS row_index")
    top, _ = plan(deduplicate(frame))
    assert top.count("Exchange (") == 1 and top.count("Aggregate (") == 2 and "Window" not in top


def test_retrieval_sums_where_documents_are_placed(spark):
    vectors = spark.range(200).selectExpr("id AS key", "array(CAST(id % 7 AS INT)) AS idx", "array(1.0D) AS val")
    asked = spark.range(5).selectExpr("id AS query", "CAST(id AS INT) AS i", "1.0D AS wq", "0.1D AS bound", "0.0D AS left")
    met = similar._open(asked, similar.Index(vectors, vectors), 1)
    top, _ = plan(met)
    # documents are placed once; products and sums follow in that stage, and only open pairs leave it
    assert "Exchange" not in top.split("BroadcastHashJoin")[0] and top.split("BroadcastHashJoin")[1].count("- Exchange (") == 1
    best, _ = plan(similar.top_matches(met.withColumnRenamed("partial", "similarity"), 3, "query", "doc"))
    assert "WindowGroupLimit" in best


def test_scan_prunes_and_pushes(spark):
    _, text = plan(parquet_scan(spark, SF))
    assert "GreaterThanOrEqual(n_chars,1000)" in text and "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in text
