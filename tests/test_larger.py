"""Steps that were rewritten for larger tables give what they gave."""

import re

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import knowledge as K
from loomwright.sinks import writers as S


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_section(spark):
    texts = ["## A\nx\n## B\ny", "a\n## A more\n## B\nz\n\n## C\n", "## A", "t\n## A\n", "no", "", None, "x ## A\n\n## A\n### 1\n## B", "### A\n## AB\nq\n## "]
    want = [t if t is None else (m := re.search(r"(?s)(?:^|\n)## A[^\n]*\n(.*?)(?=\n## |\Z)", t)) and m[1] or "" for t in texts]
    assert [r.x for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.section(F.col("t"), "A").alias("x")).collect()] == want


def test_lint_reads_pages_once(spark):
    good = "## 时间线\n### 2024-01-01 | n | t\n\n## 综合评估\n" + "long enough " * 9
    keys = {k: "" for k in ("entity", "last_updated", "sources_count", "tags", "title", "type")}
    pages = spark.createDataFrame([("a", keys, good), ("b", {}, "ÀÁÂÃ"), ("c", keys, good.replace("### ", "#### ")), ("d", keys, None)], "path string, meta map<string,string>, content string")
    got = K.lint(pages)
    assert sorted((r.path, r.category) for r in got.collect()) == [("b", "empty timeline"), ("b", "frontmatter"), ("b", "mojibake"), ("b", "no assessment")]
    assert "Union" not in plan(got)


def test_attributes_read_pages_once(spark):
    pages = spark.createDataFrame([("e", "p", "行业：a \n类型: b\n类型： c"), ("f", "q", None)], "entity string, page string, content string")
    got = K.attributes(pages)
    assert sorted((r.attribute, r.value) for r in got.collect()) == [("类型", "b"), ("类型", "c"), ("行业", "a")]
    assert "Union" not in plan(got)


def test_texts_with_a_word_stay_where_they_are(spark):
    pages = spark.createDataFrame([(i, "x word y" + " [[word]]" * (i % 2)) for i in range(8)], "path long, content string")
    got = K.missing_cross_references(pages, spark.createDataFrame([("word",), ("none",)], "name string"))
    assert [tuple(r) for r in got.collect()] == [("word", 4)] and "SortMergeJoin" not in plan(got)


def test_routing_decisions_are_joined_from_strings(spark):
    rows = [(i * 7 % 50, None if i == 3 else f'e"{i}', "company", "news", i / 4) for i in range(50)]
    r = spark.createDataFrame(rows, "doc long, entity string, entity_type string, topic string, score double").repartition(4)
    d = F.struct(*r.columns)
    want = r.agg(F.count("*").alias("total"), F.array_sort(F.collect_list(d)).alias("decisions")).select(F.to_json(F.struct(F.lit("b").alias("batch_id"), F.lit("t").alias("timestamp"), "total", "decisions")))
    got = S.routing_decisions(r, "b", "t")
    assert got.first()[0] == want.first()[0]
    assert S.routing_decisions(r.where("doc < 0"), "b", "t").first()[0] == '{"batch_id":"b","timestamp":"t","total":0,"decisions":[]}'
    assert "collect_list(struct(doc" not in plan(got)


def test_contradicting_values_are_mined_once(spark):
    v = spark.createDataFrame([("a", "m", 1.0, p, f) for p in (1, 2) for f in ("", "x")] + [("a", "m", 9.0, 1, "y"), ("a", "m", 9.0, 3, "x")], "entity string, metric string, value double, page int, about string")
    got = K.numeric_contradictions(v)
    assert [tuple(r) for r in got.select("n_values", "n_distinct", "n_pairs").collect()] == [(6, 2, 5)] and "ExistingRDD" not in plan(got)
