"""Operators of the knowledge base: routing, search, contradictions, gaps, discovery, dashboards.

All take and return DataFrames; dates are compared with an explicit ``as_of``;
every top-k and keep-first has a total order.  Joins that multiply rows inside
a group are replaced by counts and windows over pre-aggregated values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..rules import Rules
from ..shared import written
from ..sources.readers import company_keys, keywords
from .graph import sector_topics

# ---- routing


def route(docs: DataFrame, graph: dict, rules: Rules) -> DataFrame:
    """docs (doc, text, hint) -> (doc, entity, entity_type, topic, score).

    Branches: the hinted company; the cascade of its sectors and themes;
    keywords, weighed by specificity; prominent mentions of companies.  Of each
    key the best score counts, if it reaches the least one.  Keywords and names
    come from the graph, a dimension; one pass finds them all (``containing``).
    """
    companies, nodes, edges = graph["companies"], graph["nodes"], graph["edges"]
    topics = sector_topics(nodes, edges)
    hint = docs.where(F.length("hint") > 0).select("doc", F.col("hint").alias("key"))
    named = hint.join(company_keys(companies), "key").select("doc", "company").distinct()
    a = named.select("doc", F.col("company").alias("entity"), F.lit("company").alias("entity_type"), F.lit("news").alias("topic"), F.lit(rules.hint_score).alias("score"))
    member = companies.select(F.col("name").alias("company"), F.explode(F.array_union("sectors", "themes")).alias("sector"))
    b = named.join(member, "company").join(topics, "sector").select("doc", F.col("topic").alias("entity"), F.lit("sector").alias("entity_type"), F.lit("news").alias("topic"), F.lit(rules.cascade_score).alias("score"))
    k = keywords(nodes)
    over = F.create_map(*(F.lit(x) for kv in rules.specificity.items() for x in kv)) if rules.specificity else F.create_map().cast("map<string,double>")
    k = k.withColumn("spec", F.coalesce(F.try_element_at(over, F.col("keyword")), F.lit(rules.default_specificity))).where(F.col("spec") >= rules.min_specificity)
    lowered = docs.select("doc", F.lower("text").alias("low"))
    c = containing(lowered, k, "low", "keyword").select("doc", "entity", F.col("type").alias("entity_type"), F.lit("news").alias("topic"), (F.col("spec") * rules.keyword_max).alias("score"))
    names = company_keys(companies).where((F.length("key") >= 2) & ~F.col("key").isin(*rules.name_blacklist))
    d = prominent(docs, names, rules).select("doc", F.col("company").alias("entity"), F.lit("company").alias("entity_type"), F.lit("news").alias("topic"), F.lit(rules.mention_score).alias("score"))
    best = a.unionByName(b).unionByName(c).unionByName(d).groupBy("doc", "entity", "entity_type", "topic").agg(F.max("score").alias("score"))
    return best.where(F.col("score") >= rules.min_score)


DIMENSION_BYTES = 64 << 20


def dimension(df: DataFrame) -> DataFrame:
    """Broadcast a side if the optimizer knows that it is small; else leave the plan to choose."""
    return F.broadcast(df) if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= DIMENSION_BYTES else df


def containing(docs: DataFrame, words: DataFrame, text: str, word: str) -> DataFrame:
    """docs x words where the text contains the word: one pass per batch over all words at once.

    An automaton of the words (an entity graph's names and keywords, a
    dimension that is broadcast as such) reads each text once, however many
    words there are; without its library, plain searches do.  Empty words are in no text.
    The rows of ``words`` are broadcast, too: shuffled, all texts with a word would go to one task.
    """
    held = [r[0] for r in words.select(word).where(F.length(word) > 0).distinct().collect()]
    spark = docs.sparkSession
    every = spark.sparkContext.broadcast(held)

    def run(batches):
        import pyarrow as pa

        try:
            import ahocorasick
        except ImportError:
            ahocorasick = None
        find = None
        if ahocorasick is not None and every.value:
            automaton = ahocorasick.Automaton()
            for w in every.value:
                automaton.add_word(w, w)
            automaton.make_automaton()
            find = lambda t: {w for _, w in automaton.iter(t)}
        for batch in batches:
            i = batch.schema.get_field_index(text)
            at, found = [], []
            for row, t in enumerate(batch.column(i).to_pylist()):
                hits = sorted(find(t) if find else {w for w in every.value if w in t}) if t else []
                at += [row] * len(hits)
                found += hits
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(found, pa.string())], names=[*batch.schema.names, hit])

    hit = "_hit"
    while hit in docs.columns or hit in words.columns:
        hit += "_"
    got = docs.mapInArrow(run, type(docs.schema)([*docs.schema.fields, *type(docs.schema)().add(hit, "string").fields]))
    return got.join(F.broadcast(words), F.col(hit) == F.col(word)).drop(hit)


def prominent(docs: DataFrame, names: DataFrame, rules: Rules) -> DataFrame:
    """Names near the beginning of a text, or often in it."""
    hit = containing(docs.select("doc", "text"), names, "text", "key")
    early = F.left("text", F.lit(rules.prominent_chars)).contains(F.col("key"))
    return hit.where(early | (T.mentions(F.col("text"), F.col("key")) >= rules.prominent_count)).select("doc", "company").distinct()


# ---- search


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc, token, n, total) of docs (doc, text)."""
    each = docs.select("doc", T.tokens(F.col("text")).alias("t")).select("doc", F.size("t").alias("total"), F.explode("t").alias("token"))
    return each.groupBy("doc", "total", "token").agg(F.count("*").alias("n")).select("doc", "token", "n", F.col("total").cast("long").alias("total"))


def index(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings: token, doc, w; document frequencies: token, df, idf) with idf = ln((N + 1) / (df + 1)) + 1."""
    tf = term_counts(docs)
    n = docs.agg(F.count("*").alias("N"))
    df = tf.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).withColumn("idf", F.log((F.col("N") + 1) / (F.col("df") + 1)) + 1).drop("N")
    return tf.join(df, "token").select("token", "doc", (F.col("n") / F.col("total") * F.col("idf")).alias("w")), df


def save_index(docs: DataFrame, path: str) -> None:
    """The inverted index of docs (doc, text) as tables ``counts``, ``df``, ``postings`` and ``norms`` below a path; texts are read once."""
    spark = docs.sparkSession
    term_counts(docs).write.mode("overwrite").parquet(f"{path}/counts")
    tf = spark.read.parquet(f"{path}/counts")
    n = docs.agg(F.count("*").alias("N"))
    tf.groupBy("token").agg(F.count("*").alias("df")).join(F.broadcast(n)).withColumn("idf", F.log((F.col("N") + 1) / (F.col("df") + 1)) + 1).drop("N").write.mode("overwrite").parquet(f"{path}/df")
    df = spark.read.parquet(f"{path}/df")
    w = tf.join(df, "token").select("token", "doc", (F.col("n") / F.col("total") * F.col("idf")).alias("w"))
    w.sortWithinPartitions("token").write.mode("overwrite").parquet(f"{path}/postings")
    spark.read.parquet(f"{path}/postings").groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn")).write.mode("overwrite").parquet(f"{path}/norms")


def load_index(spark, path: str) -> dict[str, DataFrame] | None:
    """A saved index, or None where there is none (whole and readable), so that the caller builds it."""
    try:
        return {t: spark.read.parquet(f"{path}/{t}") for t in ("df", "postings", "norms")}
    except Exception as e:
        if any(x in str(e) for x in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE")):
            return None
        raise


def search(postings: DataFrame, df: DataFrame, query: str, k: int = 10, norms: DataFrame | None = None) -> DataFrame:
    """The k documents of highest cosine to the query; scores are rounded after ranking.  ``norms`` (doc, dn) spares a pass over the postings."""
    spark = postings.sparkSession
    q = spark.createDataFrame([(query,)], "q string").select(F.explode(T.tokens(F.col("q"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    total = q.agg(F.sum("n").alias("m"))
    v = q.join(F.broadcast(df.join(F.broadcast(q.select("token")), "token", "left_semi")), "token").join(F.broadcast(total)).select("token", (F.col("n") / F.col("m") * F.col("idf")).alias("q"))
    length = v.agg(F.sqrt(F.sum(F.col("q") * F.col("q"))).alias("qn"))
    dots = postings.join(F.broadcast(v), "token").groupBy("doc").agg(F.sum(F.col("w") * F.col("q")).alias("dot"))
    if norms is None:
        norms = postings.join(dots.select("doc"), "doc", "left_semi").groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("dn"))
    scored = dots.join(norms, "doc").join(F.broadcast(length)).select("doc", (F.col("dot") / (F.col("dn") * F.col("qn"))).alias("score"))
    return scored.orderBy(F.desc(F.round("score", 9)), "doc").limit(k).select("doc", F.round("score", 4).alias("score"))


def heuristic_search(pages: DataFrame, question: str, words: list[str], n: int = 10) -> DataFrame:
    """pages (doc, entity, title, content) by 20 entity + 15 word in entity + 10 word in title + 5 x share of words in the text."""
    low = F.lower(F.lit(question))
    e = F.lower("entity")
    hits = sum((F.contains(F.lower("content"), F.lit(w.lower())).cast("int") for w in words), F.lit(0))
    score = F.when((F.length("entity") > 0) & F.contains(low, e), 20).otherwise(0) + F.when(T.any_of(F.contains(e, F.lit(w.lower())) for w in words), 15).otherwise(0) + F.when(T.any_of(F.contains(F.lower("title"), F.lit(w.lower())) for w in words), 10).otherwise(0) + 5.0 * hits / max(len(words), 1)
    return pages.select("doc", "entity", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc").limit(n)


def snippet(docs: DataFrame, words: list[str], width: int = 80, lead: int = 20, size: int = 200) -> DataFrame:
    """doc and the text around its densest window of hits; the first of equals."""
    low = F.lower("text")

    def of(word):
        none = F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("at"))
        parts = F.split(low, "\\Q" + word + "\\E")
        step = lambda acc, p: F.struct((acc["upto"] + F.length(p) + len(word)).alias("upto"), F.array_append(acc["at"], acc["upto"] + F.length(p)).alias("at"))
        return T.let(parts, lambda p: F.aggregate(F.slice(p, F.lit(1), F.size(p) - 1), none, step)["at"])

    places = F.flatten(F.array(*(of(w.lower()) for w in words)))
    hits = docs.where(T.any_of(low.contains(w.lower()) for w in words)).select("doc", "text", F.explode(F.array_distinct(places)).alias("at"))
    w = Window.partitionBy("doc").orderBy("at").rangeBetween(0, width - 1)
    best = hits.withColumn("n", F.count("*").over(w)).groupBy("doc").agg(F.max_by("at", F.struct("n", -F.col("at"))).alias("at"), F.any_value("text").alias("text"))
    start = F.greatest(F.col("at") - lead, F.lit(0))
    cut = F.col("text").substr(start + 1, F.lit(size))
    return best.select("doc", F.concat(F.when(start > 0, "...").otherwise(""), cut, F.when(start + size < F.length("text"), "...").otherwise("")).alias("snippet"))


# ---- contradictions


def far_pairs(values: DataFrame, keys: list[str], share: float) -> DataFrame:
    """keys -> n_pairs: pairs of positive values with equal keys that differ by more than ``share`` of the larger; values may come with their number, n.

    Pairs are counted, not made: over distinct values with their counts, a
    running total in order of value tells how many lie far below.
    """
    d = values.where("value > 0").groupBy(*keys, "value").agg((F.sum("n") if "n" in values.columns else F.count("*")).alias("n"))
    lows = d.select(*keys, F.col("value").alias("at"), F.col("n").alias("low"), F.lit(0).alias("high"))
    highs = d.select(*keys, (F.col("value") * (1 - share)).alias("at"), F.lit(0).alias("low"), F.col("n").alias("high"))
    w = Window.partitionBy(*keys).orderBy("at", "low").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = lows.unionByName(highs).withColumn("below", F.sum("low").over(w))
    return both.groupBy(*keys).agg(F.coalesce(F.sum(F.col("high") * F.col("below")), F.lit(0)).alias("n_pairs"))


def numeric_contradictions(values: DataFrame, share: float = 0.3) -> DataFrame:
    """values (entity, metric, value[, page][, about]) -> per entity and metric: values, distinct ones, and pairs that contradict.

    A pair contradicts if its values differ by more than ``share`` of the
    larger, it isn't from one page, and what its statements are about (a string;
    null or empty: nothing named) isn't named and different on both sides.
    Counted by inclusion and exclusion over ``far_pairs``, whose terms read
    values that are mined and counted once.
    """
    keys = ["entity", "metric"]
    page = ["page"] if "page" in values.columns else []
    beside = [*page, *(["about"] if "about" in values.columns else [])]
    values = values.where("value > 0").groupBy(*keys, *beside, "value").agg(F.count("*").alias("n"))
    if beside:
        values = written(values)
    terms = [(values, [], 1)] + [(values, page, -1)] * len(page)
    if "about" in values.columns:
        named = values.where(F.length("about") > 0)
        terms += [(named, [], -1), (named, ["about"], 1)] + [(named, page, 1), (named, [*page, "about"], -1)] * len(page)
    counted = None
    for v, more, sign in terms:
        t = far_pairs(v, keys + more, share).select(*keys, (F.col("n_pairs") * sign).alias("n_pairs"))
        counted = t if counted is None else counted.unionByName(t)
    d = values.groupBy(*keys, "value").agg(F.sum("n").alias("n"))
    return d.groupBy(*keys).agg(F.sum("n").alias("n_values"), F.count("*").alias("n_distinct")).join(counted.groupBy(*keys).agg(F.sum("n_pairs").alias("n_pairs")), keys).where("n_pairs > 0")


def categorical_contradictions(values: DataFrame) -> DataFrame:
    """values (entity, attribute, value) -> per key the number of conflicting pairs and the values."""
    d = values.groupBy("entity", "attribute", "value").agg(F.count("*").alias("n"))
    g = d.groupBy("entity", "attribute").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("sq"), F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_list("value")), ",").alias("vals"))
    return g.where("n_values > 1").select("entity", "attribute", ((F.col("n") * F.col("n") - F.col("sq")) / 2).cast("long").alias("n_pairs"), "n_values", "vals")


def temporal_contradictions(statements: DataFrame, overlap: float = 0.5) -> DataFrame:
    """Neighbours in time of one entity that tell the same event with different dates.

    statements: entity, date, page, pos, words (array); same event: shared words over the smaller set exceed ``overlap``.
    """
    w = Window.partitionBy("entity").orderBy("date", "page", "pos")
    s = statements.withColumn("next", F.lead(F.struct("date", "page", "words")).over(w))
    same = F.size(F.array_intersect("words", F.col("next.words"))) / F.greatest(F.least(F.size("words"), F.size("next.words")), F.lit(1)) > overlap
    return s.where(F.col("next").isNotNull() & (F.col("date") != F.col("next.date")) & same).select("entity", "date", "page", F.col("next.date").alias("other_date"), F.col("next.page").alias("other_page"))


#: Units, and the name of what they measure.
UNITS = (("%", r"\d+\.?\d*", "百分比"), ("亿", r"\d+\.?\d*", "金额（亿）"), ("万", r"\d+\.?\d*", "金额（万）"), ("倍", r"\d+", "倍数"), ("台", r"\d+", "数量（台）"), ("片", r"\d+", "数量（片）"))
FIRMS = r"[一-鿿]{2,}(?:公司|集团|股份|科技|电子|半导体)"


def statements(pages: DataFrame, around: int = 30, units=UNITS, firms: str = FIRMS) -> DataFrame:
    """(entity, page, metric, value, statement, about) of numbers with a unit in pages (entity, page, content).

    statement: the number with ``around`` characters on both sides, newlines as
    blanks; about: the firms that it names, sorted and joined by commas.
    """
    rows = pages.select("entity", "page", F.col("content").cast("string").alias("content"))
    fields = ["entity", "page", "metric", "value", "statement", "about"]

    def run(batches):
        import re

        import pyarrow as pa

        every, firm = [(re.compile(rf"({number})\s*{unit}"), name) for unit, number, name in units], re.compile(firms)
        for batch in batches:
            at, metric, value, text, about = [], [], [], [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                for pattern, name in every:
                    for m in pattern.finditer(t or ""):
                        around_ = t[max(0, m.start() - around) : m.end() + around].replace("\n", " ")
                        at.append(i), metric.append(name), value.append(float(m[1])), text.append(around_), about.append(",".join(sorted(set(firm.findall(around_)))))
            where = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(where), batch.column(1).take(where), pa.array(metric, pa.string()), pa.array(value, pa.float64()), pa.array(text, pa.string()), pa.array(about, pa.string())], names=fields)

    kind = rows.schema
    return rows.mapInArrow(run, type(kind)(kind.fields[:2]).add("metric", "string").add("value", "double").add("statement", "string").add("about", "string"))


def attributes(pages: DataFrame, names: tuple[str, ...] = ("行业", "领域", "类型", "地位", "定位")) -> DataFrame:
    """(entity, page, attribute, value) of ``name: value`` lines."""

    def of(n):
        return F.transform(F.regexp_extract_all("content", F.lit(rf"(?d){n}[：:]\s*(.+)"), F.lit(1)), lambda v: F.struct(F.lit(n).alias("attribute"), F.trim(v).alias("value")))

    found = [of(n) for n in names]
    return pages.select("entity", "page", F.explode(F.flatten(F.array_compact(F.array(*found)))).alias("x")).select("entity", "page", "x.attribute", "x.value")


# ---- dedup and cleaning


def keep_longest(rows: DataFrame, keys: list[str], text: str, order: list[str]) -> DataFrame:
    """Of each key the row of longest text, ties by ``order``: an aggregate, so that a key with many rows is combined early."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(F.length(text), *[-F.col(o) for o in order])).alias("_b"))
    return best.select(*keys, *[F.col("_b." + c).alias(c) for c in rest])


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_b"))
    return best.select(*keys, *[F.col("_b." + c).alias(c) for c in rest])


def title_dump(title, points):
    """An entry that only repeats its title."""
    p = F.get(points, F.lit(0))
    return (F.size(points) == 0) | ((F.size(points) == 1) & ((p == title) | title.contains(p) | p.contains(title) | (F.length(p) < 15)))


def report_title_only(title, points):
    return title.rlike("(报告|年报|季报|report)") & ~title.rlike(r"\d+(\.\d+)?\s*(%|亿|万)") & ~F.exists(points, lambda p: (F.length(p) > 20) & (p != title))


def needs_refinement(title, body, garbage: tuple[str, ...] = ("无可用内容", "N/A")):
    return body.isNull() | (F.trim(body) == "") | (body == title) | (F.length(body) < 20) | T.contains_any(body, garbage)


def contaminated(entries: DataFrame, allowed: DataFrame) -> DataFrame:
    """Entries (page, source_path, ...) whose source company isn't allowed on the page; no source is no contamination."""
    e = entries.withColumn("company", F.nullif(F.regexp_extract("source_path", "companies/([^/]+)/", 1), F.lit("")))
    return e.where("company IS NOT NULL").join(allowed, ["page", "company"], "left_anti")


def qualified_titles(pages: DataFrame) -> DataFrame:
    """Titles that occur once as they are; of others the first keeps its title, later ones are entity/title."""
    first = pages.groupBy("title").agg(F.min(F.struct("pos", "path")).alias("f"), F.count("*").alias("n"))
    j = pages.join(first, "title")
    return j.select("path", F.when((F.col("n") == 1) | (F.col("path") == F.col("f.path")), F.col("title")).otherwise(F.concat_ws("/", "entity", "title")).alias("key"))


# ---- gaps and lint


def orphans(pages: DataFrame) -> DataFrame:
    """Pages (title, path, content) that no page links to, by name or path."""
    to = pages.select(F.explode(F.array_union(T.wikilinks(F.col("content")), T.markdown_links(F.col("content")))).alias("target"))
    names = to.select(F.regexp_replace(F.element_at(F.split("target", "/"), -1), r"\.md$", "").alias("title")).distinct()
    return pages.select("path", "title").join(names, "title", "left_anti")


def broken_links(pages: DataFrame, known: DataFrame) -> DataFrame:
    """(path, target) of wikilinks that lead nowhere; known: target."""
    return pages.select("path", F.explode(T.wikilinks(F.col("content"))).alias("target")).distinct().join(known.select("target").distinct(), "target", "left_anti")


def broken_sources(entries: DataFrame, files: DataFrame) -> DataFrame:
    """Entries (path, source_path) whose source, relative to the page, isn't among files (path)."""
    folder = F.regexp_replace("path", r"[^/]*$", "")
    return entries.where(F.length("source_path") > 0).withColumn("resolved", T.normal_path(F.concat(folder, "source_path"))).join(files.select(T.normal_path(F.col("path")).alias("resolved")).distinct(), "resolved", "left_anti")


def missing(have: DataFrame, entities: DataFrame, kinds: list[str]) -> DataFrame:
    """entities x kinds that aren't in have (entity, kind); kinds is a short list of the caller."""
    every = entities.select("entity", F.explode(F.array(*(F.lit(k) for k in kinds))).alias("kind"))
    return every.join(have.select("entity", "kind").distinct(), ["entity", "kind"], "left_anti")


def stale(pages: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    age = T.age_days(F.col("last_updated"), as_of)
    return pages.withColumn("age_days", age).where(F.col("age_days") > days).withColumn("priority", F.when(F.col("age_days") > 90, "medium").otherwise("low"))


def unanswered(questions: DataFrame, pages: DataFrame) -> DataFrame:
    """Questions (entity, question) none of whose keywords occurs in a page of the entity."""
    hit = questions.join(pages.select("entity", F.lower("content").alias("low")), "entity").where(F.exists(T.query_keywords(F.col("question")), lambda w: F.contains(F.col("low"), F.lower(w)))).select("entity", "question").distinct()
    return questions.join(hit, ["entity", "question"], "left_anti")


def question_matches(questions: DataFrame, docs: DataFrame, least: float = 0.3) -> DataFrame:
    """(entity, question, doc, relevance, confidence): the share of a question's keywords in the entity's documents."""
    q = questions.select("entity", "question", T.query_keywords(F.col("question")).alias("kws")).where(F.size("kws") > 0)
    j = q.join(docs.select("entity", "doc", F.lower("text").alias("low")), "entity")
    r = F.size(F.filter("kws", lambda w: F.contains(F.col("low"), F.lower(w)))) / F.size("kws")
    return j.select("entity", "question", "doc", r.alias("relevance")).where(F.col("relevance") >= least).withColumn("confidence", F.when(F.col("relevance") >= 0.7, "high").when(F.col("relevance") >= 0.5, "medium").otherwise("low"))


def lint(pages: DataFrame, required: tuple[str, ...] = ("entity", "last_updated", "sources_count", "tags", "title", "type")) -> DataFrame:
    """(level, category, path) issues of front matter, timelines and assessments."""
    gone = F.filter(F.array(*(F.lit(k) for k in required)), lambda k: ~F.map_contains_key("meta", k))
    text = F.trim(T.section(F.col("content"), "综合评估"))
    found = [
        (F.size(gone) > 0, "WARNING", "frontmatter"), (T.no_timeline(F.col("content")), "INFO", "empty timeline"),
        ((F.length(text) <= 50) | text.contains("待积累"), "INFO", "no assessment"), (T.mojibake(F.col("content")), "ERROR", "mojibake"),
    ]
    issues = F.array(*(F.when(bad, F.struct(F.lit(level).alias("level"), F.lit(category).alias("category"))) for bad, level, category in found))
    return pages.select("path", F.explode(F.array_compact(issues)).alias("x")).select("x.level", "x.category", "path")


def lint_summary(issues: DataFrame) -> DataFrame:
    """How many issues (level, ...) are errors, warnings and infos: one row."""
    return issues.agg(*(F.count_if(F.col("level") == k).alias(f"n_{k.lower()}") for k in ("ERROR", "WARNING", "INFO")))


def groups_first(rows: DataFrame, group: str, order: list[str], k: int = 5) -> DataFrame:
    """Per group its number of rows and, with a rank, its first ``k`` in order."""
    w = Window.partitionBy(group)
    ranked = rows.withColumn("rank", F.row_number().over(w.orderBy(*order)))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"))
    return ranked.where(F.col("rank") <= k).join(sizes, group)


def missing_cross_references(pages: DataFrame, names: DataFrame, least: int = 3) -> DataFrame:
    """(name, n_pages): names that stand in ``least`` pages (path, content) or more that have no link with the name in it."""
    hit = containing(pages.select("path", "content"), names.select("name").distinct(), "content", "name")
    linked = F.exists(F.regexp_extract_all("content", F.lit(r"\[\[([^\]]*)\]\]"), F.lit(1)), lambda x: F.contains(x, F.col("name")))
    return hit.where(~linked).groupBy("name").agg(F.count_distinct("path").alias("n_pages")).where(F.col("n_pages") >= least)


def question_suggestions(docs: DataFrame, routed: DataFrame, patterns: list[tuple[str, str]], existing: DataFrame, top: int = 10) -> DataFrame:
    """(entity, question): templates filled from docs (doc, text) that match, for each entity of routed (doc, entity), unless asked already; the first ``top``.

    A template's ``{}`` is what its pattern's first group (or all of it) matched first.
    """
    asked = None
    for n, (pattern, template) in enumerate(patterns):
        hit = F.regexp_extract("text", f"({pattern})" if "(" not in pattern.replace(r"\(", "").replace("(?", "") else pattern, 1)
        q = docs.where(F.col("text").rlike(pattern)).select("doc", F.lit(n).alias("n"), F.replace(F.lit(template), F.lit("{}"), hit).alias("question"))
        asked = q if asked is None else asked.unionByName(q)
    new = routed.select("doc", "entity").join(asked, "doc").join(existing.select("question").distinct(), "question", "left_anti")
    return new.groupBy("entity", "question").agg(F.min(F.struct("doc", "n")).alias("o")).orderBy("o", "entity", "question").limit(top).select("entity", "question", F.lit(0.5).alias("confidence"))


def refine_manifest(timeline: DataFrame, raw: DataFrame, most: int = 1000) -> DataFrame:
    """Entries (path, date, title, body, source_path) that need refinement, each with its source's cleaned text, cut at ``most`` characters."""
    need = timeline.where(needs_refinement(F.col("title"), F.col("body")))
    source = raw.groupBy(F.col("path").alias("source_path")).agg(F.min("body").alias("raw"))
    return need.join(source, "source_path", "left").select("path", "date", "title", "source_path", F.left(T.clean_simple(F.coalesce("raw", F.lit(""))), F.lit(most)).alias("content"))


def suggestions(gaps: DataFrame) -> DataFrame:
    """Gaps (entity, topic, gap_type) with what to search for, high priority first."""
    q = F.when(F.col("gap_type") == "missing_page", F.array(F.concat("entity", F.lit(" 公司介绍")))).when(F.col("gap_type") == "outdated", F.array(F.concat("entity", F.lit(" 最新消息")), F.concat_ws(" ", "entity", "topic"))).otherwise(F.array(F.concat_ws(" ", "entity", "topic")))
    rank = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).when(F.col("priority") == "low", 2).otherwise(3)
    return gaps.withColumn("queries", q).withColumn("rank", rank).orderBy("rank", "entity", "topic")


# ---- discovery and dashboards


def discover(docs: DataFrame, rules: Rules, known: DataFrame, least: int = 2, top: int = 20) -> DataFrame:
    """Names in docs (doc, text) that aren't known, by how many documents mention them."""
    each = docs.select("doc", F.explode(T.company_names(F.col("text"), rules)).alias("name")).join(known.select("name").distinct(), "name", "left_anti")
    g = each.groupBy("name").agg(F.count("*").alias("n"), F.min("doc").alias("first_doc")).where(F.col("n") >= least)
    return g.withColumn("confidence", F.least(F.col("n") / 10.0, F.lit(1.0))).orderBy(F.desc("n"), "first_doc", "name").limit(top)


def quality_dashboard(pages: DataFrame, as_of: str) -> DataFrame:
    """Per entity type and in total: pages, entries, and floor percentages of gaps."""
    e = F.size(T.timeline(F.col("content")))
    p = pages.select("entity_type", e.alias("e"), (F.length(F.trim(T.section(F.col("content"), "综合评估"))) <= 50).alias("na"), (T.age_days(F.col("last_updated"), as_of) > 30).alias("old"))
    n = F.count("*")
    return p.rollup("entity_type").agg(n.alias("pages"), F.sum("e").alias("entries"), F.count_if("na").alias("no_assessment"), T.floor_percent(F.count_if("na"), n).alias("no_assessment_pct"), F.count_if(F.col("e") < 3).alias("few_entries"), F.count_if(F.coalesce("old", F.lit(False))).alias("stale"))


def page_facts(pages: DataFrame) -> DataFrame:
    """pages with what dashboards count: entries, questions, whether there is an assessment."""
    lines = F.filter(F.split(T.section(F.col("content"), "核心问题"), "\n"), lambda x: x.startswith("- "))
    text = F.trim(T.section(F.col("content"), "综合评估"), F.lit(" \n"))
    return pages.select("*", F.size(T.timeline(F.col("content"))).alias("entries"), F.size(lines).alias("questions"), (F.length(text) > 50).alias("has_assessment"))


def enrichment_stats(facts: DataFrame) -> DataFrame:
    """One row: pages, those with questions, with an assessment, with entries, with enough (3) for an assessment; entries' least, most and mean."""
    return facts.agg(F.count("*").alias("pages"), F.count_if(F.col("questions") > 0).alias("with_questions"), F.count_if("has_assessment").alias("with_assessment"), F.count_if(F.col("entries") > 0).alias("with_timeline"), F.count_if(F.col("entries") >= 3).alias("assessable"), F.min("entries").alias("least"), F.max("entries").alias("most"), F.round(F.avg("entries"), 6).alias("mean"))


def sector_coverage(sectors: DataFrame, members: DataFrame, facts: DataFrame) -> DataFrame:
    """Per sector (sector): companies (members: sector, name), and its first page's entries, assessment and questions."""
    first = facts.groupBy("entity").agg(F.min_by(F.struct("entries", "has_assessment", "questions"), "path").alias("f"))
    n = members.groupBy("sector").agg(F.count_distinct("name").alias("companies"))
    j = sectors.select("sector").distinct().join(n, "sector", "left").join(first, F.col("sector") == F.col("entity"), "left")
    return j.select("sector", F.coalesce("companies", F.lit(0)).alias("companies"), F.coalesce("f.entries", F.lit(0)).alias("entries"), F.coalesce("f.has_assessment", F.lit(False)).alias("has_assessment"), F.coalesce("f.questions", F.lit(0)).alias("questions"))


def run_totals(results: DataFrame) -> DataFrame:
    """One row of results (status): files, updated, skipped, failed, and the share that didn't fail (1 if there are none)."""
    n, bad = F.count("*"), F.count_if(F.col("status") == "error")
    return results.agg(n.alias("files"), F.count_if(F.col("status") == "updated").alias("updated"), F.count_if(F.col("status") == "skipped").alias("skipped"), bad.alias("failed"), F.round(F.when(n == 0, 1.0).otherwise((n - bad) / F.greatest(n, F.lit(1))), 6).alias("success_rate"))


def corpus_stats(files: DataFrame) -> DataFrame:
    """One row of a listing (path): companies, news, filings and pages, by where they lie."""
    p = F.col("path")
    return files.agg(F.count_distinct(F.nullif(F.regexp_extract("path", "companies/([^/]+)/", 1), F.lit(""))).alias("companies"), F.count_if(p.contains("/raw/news/") & p.endswith(".md")).alias("news"), F.count_if(p.endswith(".pdf")).alias("pdfs"), F.count_if(p.contains("/wiki/") & p.endswith(".md")).alias("pages"))


def link_stats(pages: DataFrame) -> DataFrame:
    """One row: wikilinks in all pages, and pages that have any."""
    n = F.regexp_count("content", F.lit(r"\[\["))
    return pages.agg(F.coalesce(F.sum(n), F.lit(0)).alias("links"), F.count_if(n > 0).alias("pages_with_links"))


def removed_share(kept: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row: kept, removed and the whole per cent removed."""
    both = kept.select(F.lit(0).alias("gone")).unionByName(rejected.select(F.lit(1).alias("gone")))
    return both.agg(F.count_if(F.col("gone") == 0).alias("kept"), F.count_if(F.col("gone") == 1).alias("removed"), T.floor_percent(F.count_if(F.col("gone") == 1), F.count("*")).alias("removed_pct"))


def slide_totals(pages: DataFrame) -> DataFrame:
    """Per entity: its pages, entries, and the sources that their front matter counts."""
    return pages.groupBy("entity").agg(F.count("*").alias("pages"), F.sum(F.size(T.timeline(F.col("content")))).alias("entries"), F.coalesce(F.sum(F.expr("try_cast(meta['sources_count'] AS int)")), F.lit(0)).alias("sources"))


def page_names(pages: DataFrame, first: int = 5) -> DataFrame:
    """name -> path for links by bare name; of pages (name, path, pos) with one name the last of the first ``first``."""
    w = Window.partitionBy("name").orderBy("pos", "path")
    return pages.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first).groupBy("name").agg(F.max_by("path", "rn").alias("path"))


def metrics(rows: DataFrame) -> DataFrame:
    """rows (kind, name, labels map, value, ts) -> per key: counters summed, gauges last, timers described."""
    labels = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    key = F.when(F.length(labels) > 0, F.concat("name", F.lit("{"), labels, F.lit("}"))).otherwise(F.col("name"))
    g = rows.withColumn("key", key).groupBy("kind", "key")
    return g.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.max_by("value", "ts").alias("last"), F.avg("value").alias("avg"), F.min("value").alias("min"), F.max("value").alias("max"))


def answer(question: str, hits: DataFrame, timeline: DataFrame, pages: int = 5, entries: int = 3) -> DataFrame:
    """A rule-made answer: the first pages of ``hits`` (doc, entity, score) with their latest entries; high confidence from three on."""
    w = Window.partitionBy("entity").orderBy(F.desc("date"), "pos")
    latest = timeline.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= entries).groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "date", "title"))), lambda x: F.concat_ws(" ", x["date"], x["title"])), "\n").alias("facts"))
    top = hits.orderBy(F.desc("score"), "doc").limit(pages).join(latest, "entity", "left")
    return top.agg(F.lit(question).alias("question"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(-F.col("score"), "doc", "facts"))), lambda x: F.coalesce(x["facts"], F.lit(""))), "\n").alias("answer"), F.count("*").alias("n_sources"), F.when(F.count("*") >= 3, "high").when(F.count("*") > 0, "medium").otherwise("low").alias("confidence"))
