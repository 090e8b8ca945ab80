"""Writers: insert-if-absent tables, timeline upsert, ledgers, reports, link tables, graph JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph as G


def insert_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` whose key isn't in ``existing``, one per key, the first in order of all columns."""
    first = new.groupBy(*keys).agg(F.min(F.struct(*[c for c in new.columns if c not in keys])).alias("_r")) if set(new.columns) - set(keys) else new.distinct().withColumn("_r", F.struct())
    rows = first.select(*keys, *([F.col("_r." + c).alias(c) for c in new.columns if c not in keys]))
    return rows.join(existing.select(*keys).distinct(), keys, "left_anti").select(*new.columns)


def low_information(title, points, body, level):
    """Too little to keep: low quality and short, or one point that says the title or almost nothing."""
    one = F.get(points, F.lit(0))
    return ((level == "low") & (F.length(body) < 100)) | ((F.size(points) == 1) & ((one == title) | (F.length(one) < 15)))


def plain_title(title):
    return F.regexp_replace(title, r"\[{2}([^\]]*)\]{2}", "$1")


def upsert_timeline(timeline: DataFrame, new: DataFrame) -> DataFrame:
    """Entries to append: informative, and new by (entity, topic, date, plain title)."""
    keys = ["entity", "topic", "date", "title_clean"]
    fresh = new.where(~low_information(F.col("title"), F.col("points"), F.col("body"), F.col("quality"))).withColumn("title_clean", plain_title(F.col("title")))
    old = timeline.select("entity", "topic", "date", plain_title(F.col("title")).alias("title_clean"))
    return insert_absent(fresh, old, keys).drop("title_clean")


def page_stats(timeline: DataFrame) -> DataFrame:
    """sources_count and last_updated of each page, derived from its entries."""
    return timeline.groupBy("entity", "topic").agg(F.count("*").alias("sources_count"), F.max("date").alias("last_updated"))


def unseen(raw: DataFrame, ledger: DataFrame) -> DataFrame:
    """Documents whose content isn't in the ledger; of equal contents the least path."""
    return insert_absent(raw.select("md5", *[c for c in raw.columns if c not in ("md5", "meta")]), ledger, ["md5"])


def apply_refined(timeline: DataFrame, refined: DataFrame) -> DataFrame:
    """Bodies replaced where (path, date, first 30 of the title) was refined; ``refined`` has one row per key."""
    r = refined.groupBy("path", "date", "title30").agg(F.min("refined").alias("refined"))
    return timeline.withColumn("title30", F.left("title", F.lit(30))).join(r, ["path", "date", "title30"], "left").withColumn("body", F.coalesce("refined", "body")).drop("refined", "title30")


def backfill_meta(pages: DataFrame, derived: DataFrame) -> DataFrame:
    """Front matter completed from ``derived`` (entity, more: map) only where a key is absent."""
    d = derived.groupBy("entity").agg(F.any_value("more").alias("more"))
    added = F.map_filter(F.coalesce("more", F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key("meta", k))
    return pages.join(d, "entity", "left").withColumn("meta", F.map_concat("meta", added)).drop("more")


def split_rejected(rows: DataFrame, bad) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by a predicate; null is kept."""
    flag = F.coalesce(bad, F.lit(False))
    return rows.where(~flag), rows.where(flag)


def link_table(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """entity -> sorted targets, from the graph's edges and the pages' links."""
    both = edges.select(F.col("src").alias("entity"), F.col("dst").alias("target")).unionByName(edges.select(F.col("dst").alias("entity"), F.col("src").alias("target"))).unionByName(pages.select("entity", F.explode(T.wikilinks(F.col("content"))).alias("target")))
    return both.where("entity <> target").distinct().groupBy("entity").agg(F.array_sort(F.collect_list("target")).alias("targets"))


def graph_json(nodes: DataFrame, companies: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per node and edge of the picture of a graph."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), F.col("name").alias("id"), F.col("type").alias("group"))).alias("json"))
    c = companies.select(F.to_json(F.struct(F.lit("node").alias("kind"), F.col("name").alias("id"), F.lit("company").alias("group"))).alias("json"))
    return n.unionByName(c).unionByName(G.all_edges(companies, edges).select(F.to_json(F.struct(F.lit("edge").alias("kind"), "src", "dst", "type")).alias("json")))


def page_from_template(kind, title, entity, as_of):
    """The Markdown of a new page; a synthesis carries its quarter."""
    head = F.when(kind == "synthesis", F.concat(title, F.lit(" "), T.quarter_stamp(F.to_date(as_of)))).otherwise(title)
    return F.format_string('---\ntitle: "%s"\nentity: "%s"\ntype: %s\nlast_updated: %s\nsources_count: 0\n---\n\n# %s\n\n## 核心问题\n\n## 时间线\n\n## 综合评估\n', head, entity, kind, as_of, head)


def entry_text(e):
    """A timeline entry as Markdown."""
    points = F.array_join(F.transform(e["points"], lambda p: F.concat(F.lit("- "), p)), "\n")
    return F.concat(F.format_string("### %s | %s | %s\n", e["date"], e["source_type"], e["title"]), points, F.when(F.length(e["source_path"]) > 0, F.concat(F.lit("\n- [来源]("), e["source_path"], F.lit(")"))).otherwise(""))


def slides(timeline: DataFrame, entries: int = 10, points: int = 5, width: int = 120) -> DataFrame:
    """Per page the latest entries, long points cut, as one Markdown deck."""
    from pyspark.sql import Window

    w = Window.partitionBy("entity", "topic").orderBy(F.desc("date"), "pos")
    cut = lambda p: F.when(F.length(p) > width, F.concat(F.left(p, F.lit(width - 3)), F.lit("..."))).otherwise(p)
    top = timeline.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= entries)
    text = F.concat(F.format_string("## %s %s\n", "date", "title"), F.array_join(F.transform(F.slice("points", 1, points), lambda p: F.concat(F.lit("- "), cut(p))), "\n"))
    return top.select("entity", "topic", F.struct("rn", text.alias("s")).alias("s")).groupBy("entity", "topic").agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["s"]), "\n\n---\n\n").alias("deck"))


def catalogue_page(companies: DataFrame, nodes: DataFrame) -> DataFrame:
    """tier, sector and its companies in one line, for an index page."""
    m = companies.select(F.explode("sectors").alias("sector"), "name").groupBy("sector").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("companies"))
    return nodes.where(F.col("type") == "sector").select(F.coalesce("tier", F.lit(99)).alias("tier"), F.col("name").alias("sector")).join(m, "sector", "left").orderBy("tier", "sector")


def routing_decisions(routed: DataFrame, batch_id: str, at: str) -> DataFrame:
    """A batch's routing as one JSON document per batch: its id, time, number of decisions and the decisions in order."""
    fields = ["doc", "entity", "entity_type", "topic", "score"]

    def joined(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([no], pa.int64()), pa.array([batch.num_rows], pa.int64()), pa.array([",".join(batch.column(0).to_pylist())])], names=["part", "no", "n", "s"])
                no += 1

    # The document is one value, so only strings of thousands of decisions meet where it is put together, not each decision.
    pieces = routed.orderBy(*(F.col(c).asc_nulls_last() for c in fields)).select(F.to_json(F.struct(*fields)).alias("s")).mapInArrow(joined, "part int, no long, n long, s string")
    whole = pieces.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.array_sort(F.collect_list(F.struct("part", "no", "s"))).alias("p"))
    head = F.to_json(F.struct(F.lit(batch_id).alias("batch_id"), F.lit(at).alias("timestamp"), "total"))
    return whole.select(F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"decisions":['), F.array_join(F.transform("p", lambda x: x["s"]), ","), F.lit("]}")).alias("json"))


def navigation_page(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The supply chain as a Mermaid graph and a list by tier: one row of Markdown."""
    flow = edges.where("type = 'upstream_of'").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("  "), F.col("src"), F.lit(" --> "), F.col("dst")))), "\n").alias("flow"))
    tiers = nodes.where("tier IS NOT NULL").groupBy("tier").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tier", "names"))), lambda x: F.concat(F.lit("- "), x["tier"].cast("string"), F.lit(": "), x["names"])), "\n").alias("tiers"))
    return flow.join(tiers).select(F.concat(F.lit("```mermaid\ngraph LR\n"), "flow", F.lit("\n```\n\n"), "tiers", F.lit("\n")).alias("content"))


def report_json(rows: DataFrame, group: str) -> DataFrame:
    """A report of findings, one JSON line per group: its name, number and findings in order."""
    rest = F.struct(*[c for c in rows.columns if c != group])
    return rows.groupBy(group).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(rest)).alias("items")).select(F.to_json(F.struct(group, "n", "items")).alias("json"))


def answer_page(question, answer, kind, as_of):
    """(name, content) of the page that an answer becomes: a concept, comparison or synthesis page, or a question's own."""
    own = ~kind.isin("concept", "comparison", "synthesis")
    name = F.when(own, F.concat(F.lit("Q_"), T.slug(question, 50))).otherwise(T.slug(question, 40))
    return F.struct(name.alias("name"), F.format_string('---\ntitle: "%s"\ntype: %s\nlast_updated: %s\n---\n\n# %s\n\n%s\n', question, F.when(own, F.lit("question")).otherwise(kind), as_of, question, answer).alias("content"))


def append_metrics(rows: DataFrame, path: str) -> None:
    """Metric rows (kind, name, labels, value, ts), errors among them, appended as JSON lines."""
    rows.write.mode("append").json(path)


def filed(docs: DataFrame, existing: DataFrame) -> DataFrame:
    """docs (path, doc_type) that aren't filed yet, with the folder of their type; a target that exists stays."""
    name = F.element_at(F.split("path", "/"), -1)
    return insert_absent(docs.select("path", "doc_type", F.concat_ws("/", "doc_type", name).alias("target")), existing, ["target"])


def append_log(df: DataFrame, path: str) -> None:
    """Operation log rows (at, op, message) appended as text."""
    df.select(F.format_string("## [%s] %s | %s", "at", "op", "message").alias("value")).write.mode("append").text(path)
