"""Registered queries of the knowledge base's own tables: pages, timelines, graph, routing, reports.

The star schema plays the knowledge base: customers are companies with one page
each, whose dated entries are their orders; nations are sectors.  Pages are
written as Markdown by the sinks and parsed again by the sources, so that each
SQL, which knows only the tables, checks both.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import RULES, _table, query
from .functions import text as T
from .operators import graph as G
from .operators import knowledge as K
from .plans import maintenance as M
from .rules import Rules
from .shared import folder, written
from .sinks import writers as S
from .sources import readers as SRC

AS_OF = "1998-08-02"
GOOD = "A customer of long standing whose balance is above nothing at all."


def _orders(spark, sf_dir) -> DataFrame:
    o, c = _table(spark, sf_dir, "orders"), _table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))


_O = "o AS (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders JOIN customer ON o_custkey = c_custkey)"


def _entries(spark, sf_dir) -> DataFrame:
    """A customer's orders as timeline entries."""
    o = _orders(spark, sf_dir)
    points = F.array(F.concat(F.lit("priority "), "o_orderpriority"), F.concat(F.lit("status "), "o_orderstatus"))
    return o.select("c_custkey", F.struct(F.col("d").alias("date"), F.col("o_orderkey").alias("key"), F.lower("o_orderstatus").alias("source_type"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), points.alias("points"), F.concat(F.lit("../raw/news/"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("source_path")).alias("e"))


def _pages(spark, sf_dir) -> DataFrame:
    """Every customer's page: written from its parts, then read as a page."""
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    after = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("next"))
    entries = _entries(spark, sf_dir).groupBy("c_custkey").agg(F.array_sort(F.collect_list("e")).alias("es"), F.max("e.date").alias("last"), F.count("*").alias("n"))
    p = c.join(after, "c_custkey", "left").join(entries, "c_custkey", "left")
    none = F.array().cast(entries.schema["es"].dataType)
    listed = F.array_join(F.transform(F.coalesce("es", none), lambda e: F.concat(S.entry_text(e), F.lit("\n\n"))), "")
    p = p.withColumn("entries", listed).withColumn("text", S.page_from_template(F.lit("company_topic"), F.col("c_name"), F.col("c_name"), F.coalesce("last", F.lit("1992-01-01"))))
    p = p.withColumn("text", F.replace("text", F.lit("sources_count: 0"), F.concat(F.lit("sources_count: "), F.coalesce("n", F.lit(0)).cast("string"))))
    p = p.withColumn("text", F.replace("text", F.lit("## 时间线\n\n"), F.concat(F.lit("## 时间线\n\n"), "entries")))
    p = p.withColumn("text", F.when(F.col("c_custkey") % 2 == 0, F.replace("text", F.lit("## 核心问题\n\n"), F.lit("## 核心问题\n\n- How does it fare?\n\n"))).otherwise(F.col("text")))
    p = p.withColumn("text", F.when(F.col("c_acctbal") > 0, F.concat("text", F.lit("\n" + GOOD + "\n"))).otherwise(F.col("text")))
    links = F.array_append(F.when((F.col("c_custkey") % 5 != 0) & F.col("next").isNotNull(), F.array("next")).otherwise(F.array().cast("array<string>")), F.concat(F.lit("Nowhere"), (F.col("c_custkey") % 7).cast("string")))
    kind = F.when(F.col("c_custkey") % 3 == 0, "sectors").otherwise("companies")
    texts = written(p.select(F.concat(kind, F.lit("/"), "c_name", F.lit("/wiki/orders.md")).alias("path"), T.related_section(F.col("text"), links).alias("text")))
    return SRC.pages_of(texts.select("path", T.frontmatter(F.col("text")).alias("meta"), "text"))


# ---- pages and timelines


@query(f"WITH {_O} SELECT c_name AS entity, d AS date, lower(o_orderstatus) AS source_type, 'Order ' || o_orderkey AS title, 'priority ' || o_orderpriority || '|status ' || o_orderstatus AS points, '../raw/news/' || o_orderkey || '.md' AS source_path, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY d, o_orderkey) - 1 AS INT) AS pos FROM o")
def page_timeline(spark, sf_dir):
    return SRC.read_timeline(_pages(spark, sf_dir)).select("entity", "date", "source_type", "title", F.array_join("points", "|").alias("points"), "source_path", "pos")


@query(f"WITH {_O} SELECT c_name AS entity, 'orders' AS topic, count(*) AS sources_count, max(d) AS last_updated FROM o GROUP BY 1")
def page_stats(spark, sf_dir):
    return S.page_stats(SRC.read_timeline(_pages(spark, sf_dir)))


_FACTS = f"{_O}, n AS (SELECT c_custkey, count(*) AS n, max(d) AS last FROM o GROUP BY 1), f AS (SELECT customer.c_custkey AS k, c_name, c_acctbal, coalesce(n, 0) AS n, coalesce(last, '1992-01-01') AS last, c_acctbal > 0 AS good, CASE WHEN customer.c_custkey % 3 = 0 THEN 'sectors' ELSE 'companies' END AS kind FROM customer LEFT JOIN n USING (c_custkey))"


@query(f"WITH {_FACTS} SELECT c_name AS title, kind AS entity_type, last AS last_updated, CAST(n AS INT) AS sources_count FROM f")
def page_frontmatter(spark, sf_dir):
    return _pages(spark, sf_dir).select("title", "entity_type", "last_updated", "sources_count")


@query(f"WITH {_FACTS} SELECT * FROM (SELECT 'WARNING' AS level, 'frontmatter' AS category, count(*) AS n FROM f UNION ALL SELECT 'INFO', 'empty timeline', count(*) FROM f WHERE n = 0 UNION ALL SELECT 'INFO', 'no assessment', count(*) FROM f WHERE NOT good) WHERE n > 0")
def lint_pages(spark, sf_dir):
    return K.lint(_pages(spark, sf_dir)).groupBy("level", "category").agg(F.count("*").alias("n"))


@query(f"WITH {_FACTS} SELECT 0::BIGINT AS n_error, count(*) AS n_warning, count(*) FILTER (WHERE n = 0) + count(*) FILTER (WHERE NOT good) AS n_info FROM f")
def lint_severity(spark, sf_dir):
    return K.lint_summary(K.lint(_pages(spark, sf_dir)))


@query(f"""WITH {_FACTS} SELECT kind AS entity_type, count(*) AS pages, CAST(sum(n) AS BIGINT) AS entries, count(*) FILTER (WHERE NOT good) AS no_assessment, CAST(floor(100 * count(*) FILTER (WHERE NOT good) / count(*)) AS BIGINT) AS no_assessment_pct,
count(*) FILTER (WHERE n < 3) AS few_entries, count(*) FILTER (WHERE date_diff('day', CAST(last AS DATE), DATE '{AS_OF}') > 30) AS stale FROM f GROUP BY ROLLUP (kind)""")
def quality_dashboard_pages(spark, sf_dir):
    return K.quality_dashboard(_pages(spark, sf_dir), AS_OF)


@query(f"WITH {_FACTS} SELECT count(*) AS pages, count(*) FILTER (WHERE k % 2 = 0) AS with_questions, count(*) FILTER (WHERE good) AS with_assessment, count(*) FILTER (WHERE n > 0) AS with_timeline, count(*) FILTER (WHERE n >= 3) AS assessable, CAST(min(n) AS INT) AS least, CAST(max(n) AS INT) AS most, round(avg(n), 6) AS mean FROM f")
def enrichment_stats(spark, sf_dir):
    return K.enrichment_stats(K.page_facts(_pages(spark, sf_dir)))


@query(f"WITH {_FACTS} SELECT n_name AS sector, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS companies, CAST(coalesce(f.n, 0) AS INT) AS entries, coalesce(f.good, false) AS has_assessment, CASE WHEN f.k % 2 = 0 THEN 1 ELSE 0 END AS questions FROM nation LEFT JOIN f ON f.k = n_nationkey")
def sector_coverage(spark, sf_dir):
    """A sector's own page is that of the customer with its number."""
    n, c = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    facts = K.page_facts(_pages(spark, sf_dir)).join(c.join(n, c.c_custkey == n.n_nationkey).select(F.col("c_name").alias("entity"), "n_name"), "entity").withColumn("entity", F.col("n_name"))
    members = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("sector"), F.col("c_name").alias("name"))
    return K.sector_coverage(n.select(F.col("n_name").alias("sector")), members, facts)


@query(f"WITH {_FACTS} SELECT c_name AS entity, 1::BIGINT AS pages, n AS entries, n AS sources FROM f")
def slide_totals(spark, sf_dir):
    return K.slide_totals(_pages(spark, sf_dir))


_LINKED = "l AS (SELECT a.c_custkey AS k, a.c_name AS name, b.c_name AS target FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 5 <> 0 UNION ALL SELECT c_custkey, c_name, 'Nowhere' || (c_custkey % 7) FROM customer)"


@query(f"WITH {_LINKED} SELECT c_name AS title, CASE WHEN c_custkey % 3 = 0 THEN 'sectors' ELSE 'companies' END || '/' || c_name || '/wiki/orders.md' AS path FROM customer WHERE c_name NOT IN (SELECT target FROM l)")
def page_orphans(spark, sf_dir):
    return K.orphans(_pages(spark, sf_dir))


@query(f"WITH {_LINKED} SELECT target, count(*) AS n FROM l WHERE target NOT IN (SELECT c_name FROM customer) GROUP BY 1")
def page_broken_links(spark, sf_dir):
    p = _pages(spark, sf_dir)
    return K.broken_links(p, p.select(F.col("title").alias("target"))).groupBy("target").agg(F.count("*").alias("n"))


@query(f"WITH {_LINKED} SELECT count(*) AS links, count(DISTINCT k) AS pages_with_links FROM l")
def link_stats(spark, sf_dir):
    return K.link_stats(_pages(spark, sf_dir))


@query(f"WITH {_LINKED}, e AS (SELECT name AS entity, target FROM l UNION SELECT c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey UNION SELECT n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT entity, string_agg(target, ',' ORDER BY target) AS targets FROM e GROUP BY 1")
def link_table(spark, sf_dir):
    n, c = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer")
    edges = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("src"), F.col("n_name").alias("dst"))
    return S.link_table(_pages(spark, sf_dir), edges).select("entity", F.array_join("targets", ",").alias("targets"))


@query(f"""WITH {_LINKED} SELECT c_name AS title, '- [' || coalesce((SELECT target || '](../../../companies/' || replace(target, '#', '%23') || ')' FROM l WHERE k = c_custkey AND target NOT LIKE 'Nowhere%'), '') AS first_link FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey < (SELECT max(c_custkey) FROM customer)""")
def page_links_markdown(spark, sf_dir):
    p = _pages(spark, sf_dir)
    names = p.select("title", F.concat(F.lit("companies/"), "title", F.lit(".md")).alias("to"))
    linked = p.select("title", "path", "content", F.explode(T.wikilinks(F.col("content"))).alias("target")).join(names.withColumnRenamed("title", "target"), "target")
    maps = linked.groupBy("title", "path", "content").agg(F.map_from_entries(F.collect_set(F.struct("target", "to"))).alias("m"))
    md = T.links_to_markdown(F.col("content"), F.col("m"), F.col("path"))
    return maps.select("title", F.regexp_extract(md, r"(- \[Customer#[^\]]*\]\([^)]*\))", 1).alias("first_link"))


@query(f"WITH {_O} SELECT c_name AS entity, count(*) AS n FROM o WHERE o_orderkey % 4 = 0 GROUP BY 1")
def broken_sources(spark, sf_dir):
    files = _orders(spark, sf_dir).where("o_orderkey % 4 <> 0").select(F.concat(F.when(F.col("c_custkey") % 3 == 0, "sectors").otherwise("companies"), F.lit("/"), "c_name", F.lit("/raw/./news/x/../"), F.col("o_orderkey").cast("string"), F.lit(".md")).alias("path"))
    return K.broken_sources(SRC.read_timeline(_pages(spark, sf_dir)), files).groupBy("entity").agg(F.count("*").alias("n"))


@query(f"WITH {_O} SELECT c_name AS page, count(*) AS n FROM o WHERE o_orderkey % 3 = 0 AND c_custkey > 1 GROUP BY 1")
def contaminated_entries(spark, sf_dir):
    """Every third order's source is filed under the customer before, which the page doesn't allow."""
    o = _orders(spark, sf_dir)
    owner = F.when((F.col("o_orderkey") % 3 == 0) & (F.col("c_custkey") > 1), F.col("c_custkey") - 1).otherwise(F.col("c_custkey"))
    e = o.select(F.col("c_name").alias("page"), F.concat(F.lit("../companies/"), owner.cast("string"), F.lit("/raw/x.md")).alias("source_path"))
    allowed = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("page"), F.col("c_custkey").cast("string").alias("company"))
    return K.contaminated(e, allowed).groupBy("page").agg(F.count("*").alias("n"))


def _raw_entries(spark, sf_dir) -> DataFrame:
    """Entries of which some only repeat their title, some are bare reports, and some occur twice."""
    o = _orders(spark, sf_dir)
    k = F.col("o_orderkey")
    title = F.when(k % 5 == 0, F.lit("年报 report")).otherwise(F.concat(F.lit("Order "), k.cast("string")))
    points = F.when(k % 7 == 0, F.array(title)).when(k % 5 == 0, F.array(F.lit("under twenty"), F.lit("short"))).otherwise(F.array(F.concat(F.lit("a point that says rather more: "), "o_orderpriority")))
    once = o.select(F.col("c_name").alias("entity"), F.lit("orders").alias("topic"), F.col("d").alias("date"), title.alias("title"), points.alias("points"), F.concat(F.lit("body "), "o_orderpriority").alias("body"), k.alias("pos"), F.lit("high").alias("quality"))
    return once.unionByName(once.where("pos % 11 = 0").withColumn("body", F.concat("body", F.lit(" and more"))))


_RAW = f"{_O}, r AS (SELECT c_name AS entity, d AS date, o_orderkey AS k, 'body ' || o_orderpriority AS body, CASE WHEN o_orderkey % 5 = 0 THEN '年报 report' ELSE 'Order ' || o_orderkey END AS title FROM o), x AS (SELECT * FROM r UNION ALL SELECT entity, date, k, body || ' and more', title FROM r WHERE k % 11 = 0)"


@query(f"""WITH {_RAW}, y AS (SELECT *, CASE WHEN k % 7 = 0 THEN 'title dump' WHEN k % 5 = 0 THEN 'report title' ELSE 'kept' END AS why FROM x)
SELECT why, CASE WHEN why = 'kept' THEN count(DISTINCT k) ELSE count(*) END AS n, CASE WHEN why = 'kept' THEN CAST(sum(length(body)) FILTER (WHERE k % 11 <> 0 OR body LIKE '% and more') AS BIGINT) ELSE 0 END AS chars FROM y GROUP BY why""")
def cleaned_timeline(spark, sf_dir):
    out = M.clean_timeline(_raw_entries(spark, sf_dir))
    kept = out["kept"].agg(F.lit("kept").alias("why"), F.count("*").alias("n"), F.sum(F.length("body")).alias("chars"))
    return kept.unionByName(out["rejected"].groupBy("why").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("chars")))


@query(f"WITH {_RAW} SELECT count(*) FILTER (WHERE k % 7 <> 0) AS kept, count(*) FILTER (WHERE k % 7 = 0) AS removed, CAST(floor(100 * count(*) FILTER (WHERE k % 7 = 0) / count(*)) AS BIGINT) AS removed_pct FROM x")
def removed_share(spark, sf_dir):
    kept, gone = S.split_rejected(_raw_entries(spark, sf_dir), K.title_dump(F.col("title"), F.col("points")))
    return K.removed_share(kept, gone)


@query(f"WITH {_O} SELECT c_name AS entity, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM o WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 <> 0 GROUP BY 1")
def timeline_upsert(spark, sf_dir):
    """Orders of even number are there already, linked; of the rest every third says too little."""
    o = _orders(spark, sf_dir)
    title = F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"))
    points = F.when(F.col("o_orderkey") % 3 == 0, F.array(title)).otherwise(F.array(F.lit("a point that says rather more")))
    new = o.select(F.col("c_name").alias("entity"), F.lit("orders").alias("topic"), F.col("d").alias("date"), title.alias("title"), points.alias("points"), F.lit("body").alias("body"), F.lit("high").alias("quality"), F.col("o_orderkey").alias("key"))
    old = new.where("key % 2 = 0").withColumn("title", F.concat(F.lit("[["), "title", F.lit("]]")))
    return S.upsert_timeline(old, new.unionByName(new.where("key % 5 = 1"))).groupBy("entity").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query(f"WITH {_O} SELECT o_orderkey AS key, CASE WHEN o_orderkey % 2 = 0 THEN 'refined ' || o_orderpriority ELSE o_orderpriority END AS body FROM o")
def refined_bodies(spark, sf_dir):
    t = _orders(spark, sf_dir).select(F.col("c_name").alias("path"), F.col("d").alias("date"), F.concat(F.col("o_orderkey").cast("string"), F.lit(" and a title of more than thirty characters")).alias("title"), F.col("o_orderpriority").alias("body"), F.col("o_orderkey").alias("key"))
    refined = t.where("key % 2 = 0").select("path", "date", F.left("title", F.lit(30)).alias("title30"), F.concat(F.lit("refined "), "body").alias("refined"))
    return S.apply_refined(t, refined).select("key", "body")


@query(f"WITH {_O} SELECT 'Order ' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'text of ' || o_orderpriority END AS content FROM o WHERE o_orderkey % 2 = 0")
def refine_manifest(spark, sf_dir):
    o = _orders(spark, sf_dir).withColumn("source_path", F.concat(F.lit("raw/"), F.col("o_orderkey").cast("string")))
    t = o.select(F.col("c_name").alias("path"), F.col("d").alias("date"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.when(F.col("o_orderkey") % 2 == 0, "N/A").otherwise("a body that is long enough to stay").alias("body"), "source_path")
    raw = o.where("o_orderkey % 3 <> 0").select(F.col("source_path").alias("path"), F.concat(F.lit("<p>text  of</p> "), "o_orderpriority").alias("body"))
    return K.refine_manifest(t, raw).select("title", "content")


@query("SELECT c_name AS entity, CASE WHEN c_custkey % 2 = 0 THEN 'own' ELSE c_mktsegment END AS segment, CAST(c_nationkey AS VARCHAR) AS nation FROM customer")
def backfill_meta(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    none = F.create_map().cast("map<string,string>")
    pages = c.select(F.col("c_name").alias("entity"), F.when(F.col("c_custkey") % 2 == 0, F.create_map(F.lit("segment"), F.lit("own"))).otherwise(none).alias("meta"))
    derived = c.select(F.col("c_name").alias("entity"), F.create_map(F.lit("segment"), "c_mktsegment", F.lit("nation"), F.col("c_nationkey").cast("string")).alias("more"))
    return S.backfill_meta(pages, derived).select("entity", F.col("meta")["segment"].alias("segment"), F.col("meta")["nation"].alias("nation"))


@query("WITH p AS (SELECT p_brand AS title, p_partkey, 'parts/' || p_partkey AS path, min(p_partkey) OVER (PARTITION BY p_brand) AS first, count(*) OVER (PARTITION BY p_brand) AS n, p_type FROM part) SELECT path, CASE WHEN n = 1 OR p_partkey = first THEN title ELSE p_type || '/' || title END AS key FROM p")
def qualified_titles(spark, sf_dir):
    p = _table(spark, sf_dir, "part").select(F.col("p_brand").alias("title"), F.col("p_partkey").alias("pos"), F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_type").alias("entity"))
    return K.qualified_titles(p)


@query("SELECT name, max_by(path, rn) AS path FROM (SELECT p_brand AS name, 'parts/' || p_partkey AS path, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn <= 5 GROUP BY 1")
def page_names(spark, sf_dir):
    return K.page_names(_table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.concat(F.lit("parts/"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("pos")))


@query(f"""WITH {_O}, t AS (SELECT c_name AS entity, d, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY c_custkey ORDER BY d DESC, o_orderkey) AS rn FROM o)
SELECT entity, 'orders' AS topic, md5(string_agg('## ' || d || ' Order ' || o_orderkey || chr(10) || '- priority ' || o_orderpriority, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rn)) AS deck_md5 FROM t WHERE rn <= 10 GROUP BY 1""")
def slide_decks(spark, sf_dir):
    t = SRC.read_timeline(_pages(spark, sf_dir))
    return S.slides(t, points=1).select("entity", "topic", F.md5("deck").alias("deck_md5"))


@query(f"WITH {_O}, t AS (SELECT c_name AS entity, d, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY d DESC, o_orderkey) AS rn FROM o), a AS (SELECT entity, string_agg(d || ' Order ' || o_orderkey, chr(10) ORDER BY rn) AS facts FROM t WHERE rn <= 3 GROUP BY 1), h AS (SELECT c_custkey, c_name, CAST(c_custkey % 10 AS DOUBLE) AS s FROM customer ORDER BY s DESC, c_custkey LIMIT 5) SELECT 'who?' AS question, string_agg(coalesce(facts, ''), chr(10) ORDER BY s DESC, c_custkey) AS answer, count(*) AS n_sources, 'high' AS confidence FROM h LEFT JOIN a ON entity = c_name")
def answer_from_pages(spark, sf_dir):
    hits = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"), F.col("c_name").alias("entity"), (F.col("c_custkey") % 10).cast("double").alias("score"))
    return K.answer("who?", hits, SRC.read_timeline(_pages(spark, sf_dir)))


# ---- contradictions over statements mined from pages


@query("""WITH v AS (SELECT l_partkey AS entity, l_suppkey AS page, CAST(l_quantity AS BIGINT)::DOUBLE AS value, CASE WHEN l_returnflag = 'A' THEN '' ELSE '部件' || CASE WHEN l_returnflag = 'N' THEN '甲' ELSE '乙' END || '公司' END AS about FROM lineitem WHERE l_quantity >= 1),
t AS (SELECT entity, count(*) AS n_values, count(DISTINCT value) AS n_distinct FROM v GROUP BY 1), i AS (SELECT *, row_number() OVER () AS r FROM v)
SELECT a.entity, any_value(t.n_values) AS n_values, any_value(t.n_distinct) AS n_distinct, count(*) AS n_pairs FROM i a JOIN i b ON a.entity = b.entity AND a.r < b.r AND a.page <> b.page AND least(a.value, b.value) < greatest(a.value, b.value) * (1 - CAST(0.3 AS DOUBLE)) AND (a.about = '' OR b.about = '' OR a.about = b.about) JOIN t ON t.entity = a.entity GROUP BY 1""")
def page_numeric_contradictions(spark, sf_dir):
    """Pages of a part by supplier say how many pieces; mined from their text, compared across pages."""
    li = _table(spark, sf_dir, "lineitem").where("l_quantity >= 1")
    about = F.when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.concat(F.lit("部件"), F.when(F.col("l_returnflag") == "N", "甲").otherwise("乙"), F.lit("公司")))
    line = F.concat(about, F.lit(" sold "), F.col("l_quantity").cast("long").cast("string"), F.lit(" 台"), F.repeat(F.lit("."), F.lit(40)))
    pages = li.select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("page"), line.alias("s")).groupBy("entity", "page").agg(F.array_join(F.array_sort(F.collect_list("s")), "\n").alias("content"))
    return K.numeric_contradictions(K.statements(pages)).drop("metric")


@query("""WITH v AS (SELECT o_custkey AS entity, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY ALL)
SELECT entity, '类型' AS attribute, CAST((sum(n) * sum(n) - sum(n * n)) / 2 AS BIGINT) AS n_pairs, count(*) AS n_values, string_agg(value, ',' ORDER BY value) AS vals FROM v GROUP BY 1 HAVING count(*) > 1""")
def page_categorical_contradictions(spark, sf_dir):
    pages = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("entity")).agg(F.array_join(F.collect_list(F.concat(F.lit("类型： "), "o_orderstatus")), "\n").alias("content")).withColumn("page", F.lit("p"))
    return K.categorical_contradictions(K.attributes(pages))


@query("""WITH e AS (SELECT user_id AS entity, CAST(ts AS DATE) AS date, event_id, [event_type, 'by', 'v' || (event_id % 3)] AS w FROM events), n AS (SELECT *, lead(date) OVER x AS nd, lead(event_id) OVER x AS ni, lead(w) OVER x AS nw FROM e WINDOW x AS (PARTITION BY entity ORDER BY date, event_id))
SELECT entity, strftime(date, '%Y-%m-%d') AS date, event_id AS page, strftime(nd, '%Y-%m-%d') AS other_date, ni AS other_page FROM n WHERE nd IS NOT NULL AND nd <> date AND len(list_intersect(w, nw)) > 1.5""")
def page_temporal_contradictions(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("entity"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_id").alias("page"), F.lit(0).alias("pos"), F.array("event_type", F.lit("by"), F.concat(F.lit("v"), (F.col("event_id") % 3).cast("string"))).alias("words"))
    return K.temporal_contradictions(e)


# ---- questions and gaps


@query(f"WITH {_O} SELECT c_name AS entity, 'URGENT?' AS question FROM customer c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.c_custkey = c.c_custkey AND o_orderpriority = '1-URGENT')")
def unanswered_questions(spark, sf_dir):
    c, o = _table(spark, sf_dir, "customer"), _orders(spark, sf_dir)
    pages = o.groupBy(F.col("c_name").alias("entity")).agg(F.array_join(F.collect_set("o_orderpriority"), " ").alias("content"))
    q = c.select(F.col("c_name").alias("entity"), F.lit("URGENT?").alias("question"))
    return K.unanswered(q, pages)


@query(f"WITH {_O}, r AS (SELECT c_name AS entity, o_orderkey AS doc, ((o_orderpriority = '1-URGENT')::INT + (o_orderstatus = 'F')::INT + 1) / 3.0 AS relevance FROM o) SELECT entity, doc, round(relevance, 6) AS relevance, CASE WHEN relevance >= 0.7 THEN 'high' WHEN relevance >= 0.5 THEN 'medium' ELSE 'low' END AS confidence FROM r")
def question_relevance(spark, sf_dir):
    docs = _orders(spark, sf_dir).select(F.col("c_name").alias("entity"), F.col("o_orderkey").alias("doc"), F.concat_ws(" ", F.lit("order"), "o_orderpriority", F.concat(F.lit("state"), "o_orderstatus")).alias("text"))
    q = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("entity"), F.lit("order URGENT stateF?").alias("question"))
    return K.question_matches(q, docs).select("entity", "doc", F.round("relevance", 6).alias("relevance"), "confidence")


@query(f"WITH {_FACTS} SELECT c_name AS entity, CASE WHEN n = 0 THEN 0 ELSE 2 END AS rank, CASE WHEN n = 0 THEN c_name || ' 公司介绍' ELSE c_name || ' 最新消息|' || c_name || ' orders' END AS queries FROM f WHERE n = 0 OR last < '1998-06-01'")
def gap_suggestions(spark, sf_dir):
    f = K.page_facts(_pages(spark, sf_dir))
    gaps = f.select("entity", F.lit("orders").alias("topic"), F.when(F.col("entries") == 0, "missing_page").when(F.col("last_updated") < "1998-06-01", "outdated").alias("gap_type"), F.when(F.col("entries") == 0, "high").otherwise("low").alias("priority")).where("gap_type IS NOT NULL")
    return K.suggestions(gaps).select("entity", "rank", F.array_join("queries", "|").alias("queries"))


@query("WITH e AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rank, count(*) OVER (PARTITION BY event_type) AS n FROM events) SELECT event_type, event_id, rank, n FROM e WHERE rank <= 5")
def groups_first(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_type", "event_id", (-F.col("value")).alias("v"))
    return K.groups_first(e, "event_type", ["v", "event_id"]).select("event_type", "event_id", "rank", "n")


WORDS = ("ontion", "heit", "ción", "the", "keit", "absentword")


@query(f"SELECT name, count(*) AS n_pages FROM documents, (VALUES {', '.join(f'({w!r})' for w in WORDS)}) w(name) WHERE contains(text, name) AND NOT (name = 'heit' AND doc_id % 2 = 0) GROUP BY 1 HAVING count(*) >= 3")
def missing_cross_references(spark, sf_dir):
    """Every second text links one of the names."""
    d = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.concat("text", F.when(F.col("doc_id") % 2 == 0, " [[see heit|it]]").otherwise("")).alias("content"))
    return K.missing_cross_references(d, spark.createDataFrame([(w,) for w in WORDS], "name string"))


@query("""WITH m AS (SELECT doc_id AS doc, source AS entity, text FROM documents), q AS (SELECT doc, entity, 0 AS n, 'What of ' || regexp_extract(text, '([0-9]+)%', 1) || ' per cent?' AS question FROM m WHERE regexp_matches(text, '([0-9]+)%') UNION ALL SELECT doc, entity, 1, 'Why clown?' FROM m WHERE regexp_matches(text, '(clown)'))
SELECT entity, question, CAST(0.5 AS DOUBLE) AS confidence FROM (SELECT entity, question, min((doc, n)) AS o FROM q GROUP BY 1, 2) WHERE question NOT IN (SELECT 'What of 1 per cent?') ORDER BY o, entity, question LIMIT 10""")
def question_suggestions(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return K.question_suggestions(d.select(F.col("doc_id").alias("doc"), "text"), d.select(F.col("doc_id").alias("doc"), F.col("source").alias("entity")), [("([0-9]+)%", "What of {} per cent?"), ("(clown)", "Why {}?")], spark.createDataFrame([("What of 1 per cent?",)], "question string"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority || ' order|产能' WHEN o_orderkey % 3 = 1 THEN '订单' ELSE o_orderpriority END AS words FROM orders")
def question_subjects(spark, sf_dir):
    k = F.col("o_orderkey")
    q = F.when(k % 3 == 0, F.concat("o_orderpriority", F.lit(" order产能?"))).when(k % 3 == 1, F.lit("订单如何变化？")).otherwise(F.concat("o_orderpriority", F.lit("?")))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(T.subject_keywords(q), "|").alias("words"))


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS question_ok, length(o_orderkey::VARCHAR) = 6 OR o_orderkey % 2 = 0 AS ticker_ok, o_orderkey % 3 = 0 AS assessment_ok FROM orders")
def validity_rules(spark, sf_dir):
    k = F.col("o_orderkey")
    q = F.when(k % 4 == 0, "How is this order doing?").when(k % 4 == 1, "Too short?").when(k % 4 == 2, "No mark is in this one").otherwise(F.concat(F.repeat(F.lit("long "), F.lit(30)), F.lit("?")))
    q = F.when(k % 4 == 1, "Short?").otherwise(q)
    t = F.when(k % 2 == 0, F.concat(k.cast("string"), F.lit(".SZ"))).otherwise(k.cast("string"))
    a = F.when(k % 3 == 0, F.lit("It ships 12 of these a week, which is more than it did in any year before.")).when(k % 3 == 1, "It ships 12.").otherwise("It ships rather more of these a week than it did in any of the years before.")
    return _table(spark, sf_dir, "orders").select("o_orderkey", T.valid_question(q).alias("question_ok"), T.valid_ticker(t).alias("ticker_ok"), T.valid_assessment(a).alias("assessment_ok"))


# ---- graph and routing


def _graph(spark, sf_dir) -> dict:
    """Regions and nations as nodes, suppliers as companies; the edges of the flow among nations."""
    n, r, s = (_table(spark, sf_dir, t) for t in ("nation", "region", "supplier"))
    none = F.array().cast("array<string>")
    node = lambda name, kind, tier, pos: [name.alias("name"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("description"), tier.cast("int").alias("tier"), F.array(F.concat(name, F.lit(" Word")), F.concat(F.lit("Shared"), (pos % 4).cast("string"))).alias("keywords"), none.alias("parent_theme"), none.alias("parent_sector"), pos.cast("int").alias("pos")]
    nodes = n.select(*node(F.col("n_name"), "sector", F.col("n_regionkey"), F.col("n_nationkey"))).unionByName(r.select(*node(F.col("r_name"), "theme", F.lit(9), F.col("r_regionkey") + 100)))
    companies = s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("s_name").alias("name"), F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), F.when(F.col("s_suppkey") % 2 == 0, "SSE").otherwise("NYSE").alias("exchange"), F.array("n_name").alias("sectors"), none.alias("themes"), F.array(F.concat(F.lit("Alias "), F.col("s_suppkey").cast("string")), F.lit("T1")).alias("aliases"), F.array(F.lit("Supplier of none")).alias("competes_with"), F.col("s_suppkey").cast("int").alias("pos"))
    m = n.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("dst"), F.col("n_regionkey").alias("r2"))
    flow = n.join(m, F.col("k2") == F.col("n_nationkey") + 1).select(F.col("n_name").alias("src"), "dst", F.lit("upstream_of").alias("type"), F.lit("feeds").alias("label"), F.col("n_nationkey").cast("int").alias("pos"))
    inside = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"), F.lit("belongs_to").alias("type"), F.lit(None).cast("string").alias("label"), F.col("n_nationkey").cast("int").alias("pos"))
    return {"nodes": nodes, "companies": companies, "edges": flow.unionByName(inside)}


_FLOW = "flow AS (SELECT a.n_name AS src, b.n_name AS dst FROM nation a JOIN nation b ON b.n_nationkey = a.n_nationkey + 1), mem AS (SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey), com AS (SELECT s_name, s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@query(f"WITH {_FLOW} SELECT src, dst, 'upstream_of' AS type FROM flow UNION ALL SELECT src, dst, 'belongs_to' FROM mem UNION ALL SELECT s_name, n_name, 'belongs_to' FROM com UNION ALL SELECT s_name, 'Supplier of none', 'competes_with' FROM com")
def graph_all_edges(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return G.all_edges(g["companies"], g["edges"])


@query(f"WITH {_FLOW} SELECT src, dst, 'upstream_of' AS type, 'feeds' AS label FROM flow UNION ALL SELECT src, dst, 'belongs_to', NULL FROM mem UNION ALL SELECT dst, src, 'upstream_of', 'back' FROM flow")
def graph_add_edges(spark, sf_dir):
    e = _graph(spark, sf_dir)["edges"]
    new = e.where("type = 'upstream_of'")
    back = new.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "type", F.lit("back").alias("label"), "pos")
    return G.add_edge(e, new.unionByName(back)).select("src", "dst", "type", "label")


@query(f"WITH {_FLOW} SELECT dst AS entity, 'up' AS way, src AS other FROM flow WHERE dst = (SELECT n_name FROM nation WHERE n_nationkey = 5) UNION ALL SELECT src, 'down', dst FROM flow WHERE src = (SELECT n_name FROM nation WHERE n_nationkey = 5)")
def graph_neighbours(spark, sf_dir):
    e = _graph(spark, sf_dir)["edges"]
    name = _table(spark, sf_dir, "nation").where("n_nationkey = 5").first()["n_name"]
    up, down = (f(e, name).select(F.lit(name).alias("entity"), F.lit(w).alias("way"), F.col("entity").alias("other")) for f, w in ((G.upstream, "up"), (G.downstream, "down")))
    return up.unionByName(down)


@query(f"WITH {_FLOW} SELECT n_name AS sector, n_name AS topic FROM nation UNION SELECT r_name, r_name FROM region UNION SELECT dst, src FROM mem")
def graph_sector_topics(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return G.sector_topics(g["nodes"], g["edges"])


@query(f"WITH {_FLOW} SELECT s_name AS company, n.n_name AS sector, n_regionkey AS tier, coalesce((SELECT src FROM flow WHERE dst = n.n_name), '') AS upstream, coalesce((SELECT dst FROM flow WHERE src = n.n_name), '') AS downstream FROM com JOIN nation n USING (n_name)")
def company_sector_info(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return G.company_sectors(g["companies"], g["nodes"], g["edges"]).select("company", "sector", "tier", F.array_join("upstream", ",").alias("upstream"), F.array_join("downstream", ",").alias("downstream"))


@query("SELECT string_agg(n_name, '>' ORDER BY n_nationkey) AS path, 6 AS hops FROM nation WHERE n_nationkey BETWEEN 3 AND 9")
def graph_find_path(spark, sf_dir):
    names = {r.n_nationkey: r.n_name for r in _table(spark, sf_dir, "nation").where("n_nationkey IN (3, 9)").collect()}
    e = _graph(spark, sf_dir)["edges"].where("type = 'upstream_of'")
    return G.find_path(e, names[3], names[9]).select(F.array_join("path", ">").alias("path"), "hops")


@query("WITH k AS (SELECT lower(n_name) || ' word' AS keyword, n_name AS entity, 'sector' AS type FROM nation UNION ALL SELECT lower(r_name) || ' word', r_name, 'theme' FROM region) SELECT * FROM k UNION ALL SELECT 'shared' || m, r_name, 'theme' FROM (SELECT (r_regionkey + 100) % 4 AS m, max(r_regionkey) AS r FROM region GROUP BY 1) JOIN region ON r = r_regionkey")
def keyword_owners(spark, sf_dir):
    return SRC.keywords(_graph(spark, sf_dir)["nodes"])


@query("SELECT s_name AS key, s_name AS company FROM supplier UNION ALL SELECT 'T' || s_suppkey, s_name FROM supplier UNION ALL SELECT 'Alias ' || s_suppkey, s_name FROM supplier")
def company_lookup(spark, sf_dir):
    c = _graph(spark, sf_dir)["companies"]
    return SRC.lookup(c, SRC.company_keys(c).select("key").distinct())


ROUTE_NODES = (("Energy", "sector", ("ontion", "absentword")), ("Transport", "sector", ("heit",)), ("Rail", "subsector", ("keit",)), ("Finance", "theme", ("ción",)), ("Weak", "theme", ("the",)))
ROUTE_COMPANIES = (("clown", ("Energy",), ()), ("scum", (), ("stnt",)), ("moron", ("Transport",), ()))


@query("""WITH kw(keyword, entity, type, spec) AS (VALUES ('ontion', 'Energy', 'sector', CAST(0.9 AS DOUBLE)), ('absentword', 'Energy', 'sector', 0.5), ('heit', 'Transport', 'sector', 0.5), ('keit', 'Rail', 'subsector', 0.5), ('ción', 'Finance', 'theme', 0.5)),
co(company, key) AS (VALUES ('clown', 'clown'), ('scum', 'scum'), ('scum', 'stnt'), ('moron', 'moron')), cas(company, topic) AS (VALUES ('clown', 'Energy'), ('moron', 'Transport'), ('moron', 'Rail')),
d AS (SELECT doc_id AS doc, text, CASE doc_id % 10 WHEN 0 THEN 'moron' WHEN 1 THEN 'clown' ELSE '' END AS hint FROM documents),
x AS (SELECT doc, hint AS entity, 'company' AS entity_type, CAST(1.0 AS DOUBLE) AS score FROM d WHERE hint <> ''
UNION ALL SELECT doc, topic, 'sector', 0.8 FROM d JOIN cas ON hint = company
UNION ALL SELECT doc, entity, type, spec * CAST(0.7 AS DOUBLE) FROM d JOIN kw ON contains(lower(text), keyword)
UNION ALL SELECT DISTINCT doc, company, 'company', CAST(0.3 AS DOUBLE) FROM d JOIN co ON key <> 'moron' AND contains(text, key) AND (contains(left(text, 500), key) OR (length(text) - length(replace(text, key, ''))) / length(key) >= 3))
SELECT doc, entity, entity_type, 'news' AS topic, round(max(score), 6) AS score FROM x GROUP BY ALL HAVING max(score) >= 0.3""")
def route_documents(spark, sf_dir):
    """Every document through the router: hints, the cascade, weighed keywords, prominent names."""
    none = F.array().cast("array<string>")
    nodes = spark.createDataFrame([(n, k, list(w), i) for i, (n, k, w) in enumerate(ROUTE_NODES)], "name string, type string, keywords array<string>, pos int")
    companies = spark.createDataFrame([(n, list(s), list(a)) for n, s, a in ROUTE_COMPANIES], "name string, sectors array<string>, aliases array<string>").withColumn("themes", none).withColumn("ticker", F.lit(None).cast("string"))
    edges = spark.createDataFrame([("Rail", "Transport", "belongs_to", 0)], "src string, dst string, type string, pos int")
    hint = F.when(F.col("doc_id") % 10 == 0, "moron").when(F.col("doc_id") % 10 == 1, "clown").otherwise("")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text", hint.alias("hint"))
    rules = Rules(specificity={"ontion": 0.9, "the": 0.2}, name_blacklist=("moron",))
    return K.route(docs, {"nodes": nodes, "companies": companies, "edges": edges}, rules).withColumn("score", F.round("score", 6))


# ---- listings, sinks, reports


@query("SELECT s_name AS name, 'T' || s_suppkey AS ticker, kind, CASE WHEN kind = 'ir' THEN s_suppkey % 4 ELSE s_suppkey % 7 END AS n_files FROM supplier, (VALUES ('ir'), ('reports')) k(kind) WHERE s_suppkey % 2 = 0 AND CASE WHEN kind = 'ir' THEN s_suppkey % 4 <= 1 ELSE s_suppkey % 7 <= 5 END")
def companies_to_fetch(spark, sf_dir):
    c = _graph(spark, sf_dir)["companies"]
    many = lambda n: F.sequence(F.lit(1), n)
    files = c.select("name", F.explode(F.array(F.struct(F.lit("ir").alias("kind"), (F.col("pos") % 4).alias("n")), F.struct(F.lit("reports").alias("kind"), (F.col("pos") % 7).alias("n")))).alias("x")).where("x.n > 0").select(F.col("name").alias("company"), "x.kind", F.explode(many(F.col("x.n"))))
    return SRC.to_fetch(c, files, ("SSE",), {"ir": 1, "reports": 5}).select("name", "ticker", "kind", F.col("n_files").cast("long").alias("n_files"))


@query("SELECT 'a/' || n_name AS path FROM nation WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_custkey % 50 = 0)")
def empty_folders(spark, sf_dir):
    n, c = _table(spark, sf_dir, "nation"), _table(spark, sf_dir, "customer").where("c_custkey % 50 = 0")
    files = c.join(n, c.c_nationkey == n.n_nationkey).select(F.concat(F.lit("a/"), "n_name", F.lit("/b/"), "c_name").alias("path"))
    return SRC.empty_folders(n.select(F.concat(F.lit("a/"), "n_name").alias("path")), files)


@query("SELECT (SELECT count(*) FROM customer) AS companies, (SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey) AS news, (SELECT count(*) FROM customer WHERE c_custkey % 2 = 0) AS pdfs, (SELECT count(*) FROM customer) AS pages")
def corpus_stats(spark, sf_dir):
    c = _table(spark, sf_dir, "customer")
    at = lambda *x: F.concat(F.lit("companies/"), "c_name", *x).alias("path")
    news = _orders(spark, sf_dir).select(at(F.lit("/raw/news/"), F.col("o_orderkey").cast("string"), F.lit(".md")))
    return K.corpus_stats(news.union(c.select(at(F.lit("/wiki/orders.md")))).union(c.where("c_custkey % 2 = 0").select(at(F.lit("/raw/research/x.pdf")))))


@query("SELECT count(*) AS files, count(*) FILTER (WHERE o_orderstatus = 'F') AS updated, count(*) FILTER (WHERE o_orderstatus = 'O') AS skipped, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, round(1 - count(*) FILTER (WHERE o_orderstatus = 'P') / count(*), 6) AS success_rate FROM orders")
def run_totals(spark, sf_dir):
    s = F.col("o_orderstatus")
    return K.run_totals(_table(spark, sf_dir, "orders").select(F.when(s == "F", "updated").when(s == "O", "skipped").otherwise("error").alias("status")))


@query("SELECT kind, kind || 's{type=' || event_type || '}' AS key, count(*) AS n, round(sum(value), 4) AS total, arg_max(value, event_id) AS last, min(value) AS min, max(value) AS max FROM events, (VALUES ('counter'), ('timer')) k(kind) GROUP BY kind, event_type")
def metric_tables(spark, sf_dir):
    """Metrics written as JSON lines and read again."""
    path = folder(spark)
    e = _table(spark, sf_dir, "events").select(F.explode(F.array(F.lit("counter"), F.lit("timer"))).alias("kind"), F.create_map(F.lit("type"), "event_type").alias("labels"), "value", F.col("event_id").alias("ts")).withColumn("name", F.concat("kind", F.lit("s")))
    S.append_metrics(e, path)
    rows = SRC.read_json_or_empty(spark, path, "kind string, name string, labels map<string,string>, value double, ts bigint")
    return K.metrics(rows).select("kind", "key", "n", F.round("total", 4).alias("total"), "last", "min", "max")


@query("SELECT event_type AS op, strftime(max(ts), '%Y-%m-%d %H:%M') AS at, count(*) AS n, date_diff('day', CAST(max(ts) AS DATE), DATE '2030-01-01') AS age_days FROM events GROUP BY 1")
def operations_log(spark, sf_dir):
    """Events appended as lines of a log, and read again."""
    path = folder(spark)
    S.append_log(_table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm").alias("at"), F.col("event_type").alias("op"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("message")), path)
    log = SRC.read_log(spark, path)
    out = log.groupBy("op").agg(F.max("at").alias("at"), F.count("*").alias("n"))
    return out.select("op", "at", "n", T.age_days(F.col("at"), "2030-01-01").cast("long").alias("age_days"))


@query("SELECT 'news/' || (o_orderkey % 100) || '.md' AS target, min('in/' || o_custkey || '/' || (o_orderkey % 100) || '.md') AS path FROM orders WHERE o_orderkey % 100 >= 10 GROUP BY 1")
def filed_documents(spark, sf_dir):
    d = _table(spark, sf_dir, "orders").select(F.concat(F.lit("in/"), F.col("o_custkey").cast("string"), F.lit("/"), (F.col("o_orderkey") % 100).cast("string"), F.lit(".md")).alias("path"), F.lit("news").alias("doc_type"))
    there = spark.range(10).select(F.concat(F.lit("news/"), F.col("id").cast("string"), F.lit(".md")).alias("target"))
    return S.filed(d, there).select("target", "path")


@query("SELECT '{\"batch_id\":\"b1\",\"timestamp\":\"2024-01-01\",\"total\":' || count(*) || ',\"decisions\":[' || string_agg('{\"doc\":' || o_orderkey || ',\"entity\":\"c' || o_custkey || '\",\"entity_type\":\"company\",\"topic\":\"news\",\"score\":1.0}', ',' ORDER BY o_orderkey) || ']}' AS json FROM orders")
def routing_batch(spark, sf_dir):
    r = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("entity"), F.lit("company").alias("entity_type"), F.lit("news").alias("topic"), F.lit(1.0).alias("score"))
    return S.routing_decisions(r, "b1", "2024-01-01")


@query(f"WITH {_FLOW} SELECT '```mermaid' || chr(10) || 'graph LR' || chr(10) || (SELECT string_agg('  ' || src || ' --> ' || dst, chr(10) ORDER BY '  ' || src || ' --> ' || dst) FROM flow) || chr(10) || '```' || chr(10) || chr(10) || (SELECT string_agg('- ' || tier || ': ' || names, chr(10) ORDER BY tier) FROM (SELECT n_regionkey AS tier, string_agg(n_name, ', ' ORDER BY n_name) AS names FROM nation GROUP BY 1 UNION ALL SELECT 9, string_agg(r_name, ', ' ORDER BY r_name) FROM region)) || chr(10) AS content")
def navigation_page(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return S.navigation_page(g["nodes"], g["edges"])


@query("SELECT '{\"event_type\":\"' || event_type || '\",\"n\":' || count(*) || ',\"items\":[' || string_agg('{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}', ',' ORDER BY event_id) || ']}' AS json FROM events GROUP BY event_type")
def findings_report(spark, sf_dir):
    return S.report_json(_table(spark, sf_dir, "events").select("event_type", "event_id", "user_id"), "event_type")


@query("WITH j AS (SELECT '{\"kind\":\"node\",\"id\":\"' || n_name || '\",\"group\":\"sector\"}' AS json FROM nation UNION ALL SELECT '{\"kind\":\"node\",\"id\":\"' || r_name || '\",\"group\":\"theme\"}' FROM region UNION ALL SELECT '{\"kind\":\"node\",\"id\":\"' || s_name || '\",\"group\":\"company\"}' FROM supplier), " + _FLOW + ", e AS (SELECT src, dst, 'upstream_of' AS type FROM flow UNION ALL SELECT src, dst, 'belongs_to' FROM mem UNION ALL SELECT s_name, n_name, 'belongs_to' FROM com UNION ALL SELECT s_name, 'Supplier of none', 'competes_with' FROM com) SELECT json FROM j UNION ALL SELECT '{\"kind\":\"edge\",\"src\":\"' || src || '\",\"dst\":\"' || dst || '\",\"type\":\"' || type || '\"}' FROM e")
def graph_picture(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return S.graph_json(g["nodes"], g["companies"], g["edges"])


@query(f"WITH {_FLOW} SELECT n_regionkey AS tier, n.n_name AS sector, (SELECT string_agg(s_name, ', ' ORDER BY s_name) FROM com WHERE com.n_name = n.n_name) AS companies FROM nation n")
def catalogue_index(spark, sf_dir):
    g = _graph(spark, sf_dir)
    return S.catalogue_page(g["companies"], g["nodes"])


@query("SELECT o_orderkey, CASE o_orderkey % 2 WHEN 0 THEN 'Q_Order_' || o_orderkey || '_' ELSE 'Order_' || o_orderkey || '_' END AS name, '---' || chr(10) || 'title: \"Order ' || o_orderkey || '?\"' || chr(10) || 'type: ' || CASE o_orderkey % 2 WHEN 0 THEN 'question' ELSE 'synthesis' END || chr(10) || 'last_updated: 2024-01-01' || chr(10) || '---' || chr(10) || chr(10) || '# Order ' || o_orderkey || '?' || chr(10) || chr(10) || o_orderpriority || chr(10) AS content FROM orders")
def answer_pages(spark, sf_dir):
    k = F.col("o_orderkey")
    page = S.answer_page(F.concat(F.lit("Order "), k.cast("string"), F.lit("?")), F.col("o_orderpriority"), F.when(k % 2 == 0, "own").otherwise("synthesis"), F.lit("2024-01-01"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", page.alias("p")).select("o_orderkey", "p.name", "p.content")


@query("SELECT user_id, arg_min(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def first_event(spark, sf_dir):
    return K.keep_first(_table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type")


@query("SELECT min(doc_id) AS doc_id, md5(text) AS md5 FROM documents WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 3 = 0) GROUP BY 2")
def unseen_documents(spark, sf_dir):
    d = _table(spark, sf_dir, "documents").select(F.md5("text").alias("md5"), "doc_id")
    return S.unseen(d, d.where("doc_id % 3 = 0").select("md5")).select("doc_id", "md5")


@query("""WITH d AS (SELECT doc_id, text, md5(text) AS md5, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents)
SELECT CASE WHEN regexp_matches(text, '[À-ÿ]{4,}') THEN 'mojibake' WHEN length(text) < 50 THEN 'too short' ELSE 'low quality' END AS reason, count(*) AS n FROM d WHERE rn = 1 AND (regexp_matches(text, '[À-ÿ]{4,}') OR length(text) < 50) GROUP BY 1""")
def ingest_skipped(spark, sf_dir):
    """The ingest plan over all documents: what it skips for damage or length, and why."""
    raw = _table(spark, sf_dir, "documents").select(F.format_string("%020d", "doc_id").alias("path"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("source_url"), F.lit("2024-01-01").alias("published_date"), F.col("text").alias("body"), F.md5("text").alias("md5"))
    nodes = spark.createDataFrame([("Energy", "sector", ["ontion"], 0)], "name string, type string, keywords array<string>, pos int")
    none = F.array().cast("array<string>")
    companies = spark.createDataFrame([("clown", None)], "name string, ticker string").select("name", "ticker", none.alias("sectors"), none.alias("themes"), none.alias("aliases"))
    edges = spark.createDataFrame([], "src string, dst string, type string, pos int")
    out = M.ingest(raw, spark.createDataFrame([], "md5 string"), {"nodes": nodes, "companies": companies, "edges": edges}, RULES)
    return out["skipped"].where("reason <> 'low quality'").groupBy("reason").agg(F.count("*").alias("n"))
