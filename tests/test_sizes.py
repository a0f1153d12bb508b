"""Faults that only larger tables show, on small ones."""

import duckdb
from pyspark.sql import functions as F

from claimweave import catalogue
from claimweave.functions import once, text
from claimweave.operators import extraction, modelling, relations, research
from claimweave.plans import questions

from conftest import as_rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_lists_of_answers_are_not_broadcast(spark):
    reports = spark.range(9).select(F.col("id").alias("question_id"), *[F.lit("x").alias(n) for n in ("verdict", "answer")], *[F.array(F.lit("x")).alias(n) for n in ("bullets", "verify", "codes")])
    assert "Broadcast" not in plan_of(modelling.accept_answers(reports.select("question_id", "answer", "bullets", "verify"), reports))


def test_device_names_of_keys_with_seven_digits(spark, rows_of, tmp_path):
    rows = [(k, k % 4 + 1) for k in (0, 17, 999_998, 999_999, 1_000_000, 1_000_001, 1_199_999)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    found = duckdb.sql(catalogue.SQL["device_names"].replace("FROM part", f"FROM '{tmp_path}/part.parquet/*.parquet'"))
    assert rows_of(catalogue.device_names(spark, str(tmp_path))) == as_rows(found.columns, found.fetchall())


def test_questions_of_one_file_are_dealt_out(spark):
    asked = spark.range(20).coalesce(1).select(F.col("id").alias("question_id"), F.lit("Which phones use the GH82-12345A battery?").alias("question"))
    assert questions.search_queries(questions.understand(asked)).rdd.getNumPartitions() == 4


def test_deletes_sort_no_table(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where tables are large
    try:
        a, b = spark.range(9).withColumnRenamed("id", "a"), spark.range(20).select(F.col("id").alias("b"), (F.col("id") % 9).alias("of"))
        left = relations.delete_rows({"A": a, "B": b}, {"A": "a", "B": "b"}, {"A": a.where("a < 3")}, (relations.Relation("B", "of", "A"),))
        assert "SortMergeJoin" not in plan_of(left["A"]) + plan_of(left["B"])
        assert left["A"].count() == 6 and sorted(r.b for r in left["B"].collect()) == [k for k in range(20) if k % 9 > 2]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_do_not_go_to_python_by_the_thousand(spark):
    pages = spark.createDataFrame([(1, "<p>A<p>B"), (2, ""), (3, None)], "k int, html string").select("k", text.html_to_text("html").alias("t"))
    assert "BatchEvalPython" in plan_of(pages) and "ArrowEvalPython" not in plan_of(pages)
    assert sorted(map(tuple, pages.collect())) == [(1, "A\n\nB"), (2, ""), (3, "")]


def test_results_of_one_file_are_dealt_out(spark):
    asked = spark.range(20).coalesce(1).select(F.col("id").alias("question_id"), F.lit(1).alias("scenario"))
    assert research.build_sources(catalogue.flow_tables(asked)[1]).rdd.getNumPartitions() == 4


def test_equal_segments_are_worked_out_once_for_each_group(spark):
    rows = spark.range(2000).select(F.col("id").alias("n"), F.when(F.col("id") < 1990, "often").otherwise(F.concat(F.lit("k"), "id")).alias("k"))
    found = once.with_shared(rows, "k", ["n"], size=F.length("k"), worked=F.col("n")).collect()  # ``worked`` tells the row that was worked on
    assert len(found) == 2000 and all(r.size == len(r.k) for r in found) and len({r.n for r in found}) == 2000
    assert 2 <= len({r.worked for r in found if r.k == "often"}) <= once.GROUPS and all(r.worked == r.n for r in found if r.k != "often")


def test_neither_segments_nor_questions_are_broadcast(spark):
    pages = spark.createDataFrame([(1, "s", "The battery is compatible with Samsung Galaxy A15 4G SM-A155F.")], "question_id long, source_id string, text string")
    asked = pages.select("question_id", *[F.lit(v).alias(k) for k, v in {"device": "Galaxy A15 4G", "device_brand": "Samsung", "part": "Battery", "part_number": "EB-BA155ABY", "part_category": "battery"}.items()], F.array(F.lit("SM-A155F")).alias("model_numbers"))
    found = extraction.extract_claims(pages, research.targets(asked))
    plan = plan_of(found)
    assert "Broadcast" not in plan and "[segment" in plan
    assert [(r.claim, r.model_numbers) for r in found.collect()] == [("compatible", ["SM-A155F"])]
