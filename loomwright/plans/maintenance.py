"""Composed plans: ingest of raw documents, cleaning of timelines, completion by a pluggable model."""

from __future__ import annotations

import time

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import knowledge as K
from ..rules import Rules
from ..sinks import writers as S


def ingest(raw: DataFrame, ledger: DataFrame, graph: dict, rules: Rules) -> dict[str, DataFrame]:
    """raw (path, title, company, source_url, published_date, body, md5) -> accepted entries, skipped documents with reasons, new ledger rows."""
    fresh = S.unseen(raw, ledger)
    q = T.quality(F.col("body"), rules)
    low = F.lower(F.coalesce("source_url", F.lit("")))
    reason = (
        F.when(T.contains_any(low, rules.url_blacklist) | T.contains_any(F.lower(F.coalesce("title", F.lit(""))), rules.title_blacklist), "blacklist")
        .when(T.mojibake(F.coalesce("body", F.lit(""))), "mojibake")
        .when(F.coalesce(F.length("body"), F.lit(0)) < 50, "too short")
        .when(q["action"] == "reject", "low quality")
    )
    graded = fresh.withColumn("quality", q).withColumn("reason", reason)
    good = graded.where("reason IS NULL")
    docs = good.select(F.col("path").alias("doc"), F.concat_ws(" ", "title", "body").alias("text"), F.coalesce("company", F.lit("")).alias("hint"))
    routes = K.route(docs, graph, rules)
    s = T.summary(F.col("body"), 3, rules)
    entries = routes.join(good.select(F.col("path").alias("doc"), "title", F.col("published_date").alias("date"), "body", s.alias("s")), "doc").select("entity", "entity_type", "topic", "date", F.col("s.info_type").alias("source_type"), "title", F.col("s.points").alias("points"), F.col("s.summary").alias("body"), F.col("doc").alias("source_path"), F.col("s.quality").alias("quality"), "score")
    return {"entries": entries, "skipped": graded.where("reason IS NOT NULL").select("path", "reason"), "ledger": fresh.select("md5")}


def clean_timeline(timeline: DataFrame, allowed: DataFrame | None = None) -> dict[str, DataFrame]:
    """One pass for all cleaners: damaged text, title dumps, bare report titles, duplicates, contamination."""
    bad = F.when(T.mojibake(F.coalesce("body", F.lit(""))), "mojibake").when(K.title_dump(F.col("title"), F.col("points")), "title dump").when(K.report_title_only(F.col("title"), F.col("points")), "report title")
    t = timeline.withColumn("why", bad)
    kept = K.keep_longest(t.where("why IS NULL").drop("why"), ["entity", "topic", "date", "title"], "body", ["pos"])
    rejected = t.where("why IS NOT NULL")
    if allowed is not None:
        dirty = K.contaminated(kept.withColumnRenamed("path", "page"), allowed)
        kept = kept.join(dirty.select(F.col("page").alias("path"), "date", "title").distinct(), ["path", "date", "title"], "left_anti")
    return {"kept": kept, "rejected": rejected}


def complete(prompts: DataFrame, completer=None, retries: int = 3, interval: float = 0.0) -> DataFrame:
    """prompts (id, prompt) -> (id, content, success): a model call per row, with back-off; rules answer without a completer."""

    def rule(prompt: str) -> str:
        return prompt[:200]

    call = completer or rule

    def run(frames):
        for f in frames:
            rows = []
            for i, p in zip(f["id"], f["prompt"], strict=True):
                for attempt in range(retries + 1):
                    try:
                        rows.append((i, call(p), True))
                        break
                    except Exception as e:  # noqa: BLE001  (a failed call is a result)
                        if attempt == retries:
                            rows.append((i, str(e), False))
                        else:
                            time.sleep(interval * 2**attempt)
            yield pd.DataFrame(rows, columns=["id", "content", "success"])

    return prompts.select(F.col("id").cast("string").alias("id"), "prompt").mapInPandas(run, "id string, content string, success boolean")


#: What a completer is asked, by task; ``{}`` is the text.
PROMPTS = {
    "summarise": "Summarise in three sentences, with the numbers:\n{}",
    "assess": "Assess in 50 to 800 characters what these entries show:\n{}",
    "questions": "Write core questions, one per line, that these entries leave open:\n{}",
    "relevance": "Does this text concern the entity? Answer yes or no:\n{}",
    "claims": "Do these two statements contradict each other? Answer yes or no:\n{}",
    "lint": "List what is wrong with this page, one finding per line:\n{}",
}


def prompted(rows: DataFrame, task: str, text: str = "text", most: int = 4000) -> DataFrame:
    """rows (id, text) -> (id, prompt); the prompt takes the first ``most`` characters, as a model's window is bounded."""
    head, tail = PROMPTS[task].split("{}")
    return rows.select("id", F.concat(F.lit(head), F.left(text, F.lit(most)), F.lit(tail)).alias("prompt"))


def complete_or_rule(rows: DataFrame, task: str, rule, completer=None, valid=None, retries: int = 3, interval: float = 1.0) -> DataFrame:
    """rows (id, text) -> (id, content, by): a model's answer where there is one and it is valid, else the rule's (a Column of ``text``)."""
    ruled = rows.select(F.col("id").cast("string").alias("id"), rule.alias("ruled"))
    if completer is None:
        return ruled.select("id", F.col("ruled").alias("content"), F.lit("rule").alias("by"))
    said = complete(prompted(rows, task), completer, retries, interval)
    ok = F.col("success") & (valid(F.col("content")) if valid else F.lit(True))
    return ruled.join(said, "id", "left").select("id", F.when(ok, F.col("content")).otherwise(F.col("ruled")).alias("content"), F.when(ok, "model").otherwise("rule").alias("by"))


def enrich(pages: DataFrame, rules: Rules, completer=None) -> DataFrame:
    """pages (path, content) with three entries or more and no assessment -> (path, assessment, by), validated."""
    facts = K.page_facts(pages.select("path", "content")).where("entries >= 3 AND NOT has_assessment")
    rows = facts.select(F.col("path").alias("id"), T.section(F.col("content"), "时间线").alias("text"))
    return complete_or_rule(rows, "assess", T.summary(F.col("text"), 3, rules)["summary"], completer, lambda c: T.valid_assessment(c, rules=rules)).select(F.col("id").alias("path"), F.col("content").alias("assessment"), "by")


class timed:
    """A context manager that measures a step and keeps its error: ``rows`` are as operators.knowledge.metrics takes them."""

    rows: list[tuple] = []

    def __init__(self, name: str, **labels: str):
        self.name, self.labels = name, labels

    def __enter__(self):
        self.began = time.time()
        return self

    def __exit__(self, kind, error, trace):
        self.rows.append(("timer", self.name, self.labels, time.time() - self.began, self.began))
        if error is not None:
            self.rows.append(("counter", f"{self.name}.errors", self.labels | {"error": kind.__name__}, 1.0, self.began))
        return False


def register(spark, rules: Rules | None = None) -> None:
    """The text functions as SQL functions of a session."""
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION kb_mojibake(t STRING) RETURNS BOOLEAN RETURN contains(t, chr(65533)) OR t RLIKE '[À-ÿ]{4,}'")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION kb_strip_tags(t STRING) RETURNS STRING RETURN trim(regexp_replace(regexp_replace(t, '<[^>]+>', ' '), '\\s+', ' '))")
    spark.sql(r"CREATE OR REPLACE TEMPORARY FUNCTION kb_wikilinks(t STRING) RETURNS ARRAY<STRING> RETURN array_distinct(regexp_extract_all(t, '\\[\\[([^\\]|]+)', 1))")
