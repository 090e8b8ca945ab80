"""Readers: entity graph, Markdown documents and pages, legacy encodings, JSON, logs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

NODES = "name string, type string, description string, tier int, keywords array<string>, parent_theme array<string>, parent_sector array<string>, pos int"
COMPANIES = "name string, ticker string, exchange string, sectors array<string>, themes array<string>, position string, news_queries array<string>, aliases array<string>, competes_with array<string>, pos int"
EDGES = "src string, dst string, type string, label string, pos int"
QUESTIONS = "entity string, question string, pos int"


def _list(v) -> list[str]:
    return [] if v is None else [str(x) for x in v] if isinstance(v, list) else [str(v)]


def load_graph(spark: SparkSession, path: str) -> dict[str, DataFrame | dict]:
    """nodes, companies, edges, questions (DataFrames) and settings (dict) of a YAML graph.

    A missing file raises; an empty one is an empty graph; missing keys take
    defaults, and a node without keywords has its name as one.
    """
    import yaml

    with open(path, encoding="utf-8") as f:
        y = yaml.safe_load(f) or {}
    nodes = [(n, d.get("type") or "sector", d.get("description"), d.get("tier"), _list(d.get("keywords")) or [n], _list(d.get("parent_theme")), _list(d.get("parent_sector")), i) for i, (n, d) in enumerate((y.get("nodes") or {}).items()) for d in [d or {}]]
    companies = [(n, str(d["ticker"]) if d.get("ticker") is not None else None, d.get("exchange"), _list(d.get("sectors")), _list(d.get("themes")), d.get("position"), _list(d.get("news_queries")), _list(d.get("aliases")), _list(d.get("competes_with")), i) for i, (n, d) in enumerate((y.get("companies") or {}).items()) for d in [d or {}]]
    edges = [(e.get("from"), e.get("to"), e.get("type") or "upstream_of", e.get("label"), i) for i, e in enumerate(y.get("edges") or [])]
    questions = [(e, q, i) for e, qs in (y.get("questions") or {}).items() for i, q in enumerate(qs or [])]
    make = spark.createDataFrame
    return {"nodes": make(nodes, NODES), "companies": make(companies, COMPANIES), "edges": make(edges, EDGES), "questions": make(questions, QUESTIONS), "settings": y.get("settings") or {}}


def keywords(nodes: DataFrame) -> DataFrame:
    """keyword (lower case) -> entity; of a keyword with several owners the last wins."""
    each = nodes.select(F.explode("keywords").alias("k"), F.col("name").alias("entity"), "type", "pos")
    return each.groupBy(F.lower("k").alias("keyword")).agg(F.max_by(F.struct("entity", "type"), "pos").alias("e")).select("keyword", "e.entity", "e.type")


def company_keys(companies: DataFrame) -> DataFrame:
    """Every name a company goes by: kind 0 name, 1 ticker, 2 alias."""
    name = companies.select(F.col("name").alias("key"), F.lit(0).alias("kind"), F.col("name").alias("company"))
    ticker = companies.where(F.length("ticker") > 0).select(F.col("ticker").alias("key"), F.lit(1).alias("kind"), F.col("name").alias("company"))
    alias = companies.select(F.explode("aliases").alias("key"), F.lit(2).alias("kind"), F.col("name").alias("company"))
    return name.unionByName(ticker).unionByName(alias)


def lookup(companies: DataFrame, keys: DataFrame) -> DataFrame:
    """(key) -> company by name, else ticker, else alias."""
    hit = keys.join(company_keys(companies), "key")
    return hit.groupBy("key").agg(F.min_by("company", F.struct("kind", "company")).alias("company"))


def read_markdown(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """path, meta (front matter), text, body of the Markdown files below a root."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return raw.select("path", T.frontmatter(F.col("text")).alias("meta"), "text", T.strip_frontmatter(F.col("text")).alias("body"))


def read_raw(spark: SparkSession, root: str) -> DataFrame:
    """Raw documents: everything below the root that isn't a page, with the typed core of its front matter."""
    d = read_markdown(spark, root).where(~F.col("path").contains("/wiki/"))
    get = lambda k: F.try_element_at("meta", F.lit(k)).alias(k)
    return d.select("path", get("title"), get("company"), get("source_url"), get("published_date"), get("type"), "meta", "body", F.md5(F.encode("text", "utf-8")).alias("md5"))


def read_pages(spark: SparkSession, root: str) -> DataFrame:
    """Pages below ``<kind>/<name>/wiki``; kinds and names come from the path, directories that begin with _ are skipped."""
    return pages_of(read_markdown(spark, root))


def pages_of(d: DataFrame) -> DataFrame:
    """The pages among Markdown documents (path, text, meta)."""
    where = r"(?:^|/)(companies|sectors|themes)/([^/]+)/wiki/([^/]+)\.md$"
    d = d.where(F.col("path").rlike(where)).select("*", F.regexp_extract("path", where, 1).alias("entity_type"), F.regexp_extract("path", where, 2).alias("entity_name"), F.regexp_extract("path", where, 3).alias("topic")).where(~F.col("entity_name").startswith("_"))
    get = lambda k: F.try_element_at("meta", F.lit(k))
    return d.select("path", F.coalesce(get("title"), "topic").alias("title"), F.coalesce(get("entity"), "entity_name").alias("entity"), "entity_type", "topic", get("last_updated").alias("last_updated"), F.expr("try_cast(meta['sources_count'] AS int)").alias("sources_count"), "meta", F.col("text").alias("content"))


def read_timeline(pages: DataFrame) -> DataFrame:
    """One row per dated entry of the pages."""
    return pages.select("entity_type", "entity", "topic", "path", F.explode(T.timeline(F.col("content"))).alias("e")).select("entity_type", "entity", "topic", "path", "e.*")


def read_inbox(spark: SparkSession, root: str) -> DataFrame:
    """Clipped documents of an inbox, in order of their names."""
    return read_markdown(spark, f"{root.rstrip('/')}/_inbox").withColumn("name", F.element_at(F.split("path", "/"), -1)).orderBy("name", "path")


def place(kind, entity, topic=None, root: str = ""):
    """Where a page (or, without a topic, an entity's folder) lies below the root."""
    parts = [F.lit(root.rstrip("/"))] * bool(root) + [kind, entity] + ([F.lit("wiki"), F.concat(topic, F.lit(".md"))] if topic is not None else [])
    return F.concat_ws("/", *parts)


def empty_folders(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders (path) with no file (path) below them."""
    above = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", "/"))), lambda i: F.array_join(F.slice(F.split("path", "/"), 1, i), "/"))).alias("path")).distinct()
    return folders.join(above, "path", "left_anti")


def to_fetch(companies: DataFrame, files: DataFrame, exchanges: tuple[str, ...], kinds: dict[str, int]) -> DataFrame:
    """Companies on ``exchanges`` with, per kind, no more than its number of files (company, kind); kinds: kind -> files that are enough."""
    n = files.groupBy(F.col("company").alias("name"), "kind").agg(F.count("*").alias("n"))
    want = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(m).alias("enough")) for k, m in sorted(kinds.items()))))
    each = companies.where(F.col("exchange").isin(*exchanges)).select("name", "ticker", want.alias("x")).select("name", "ticker", "x.kind", "x.enough")
    return each.join(n, ["name", "kind"], "left").where(F.coalesce("n", F.lit(0)) <= F.col("enough")).select("name", "ticker", "kind", F.coalesce("n", F.lit(0)).alias("n_files"))


def read_any_encoding(spark: SparkSession, root: str, codecs: tuple[str, ...] = ("gbk", "gb18030", "big5", "gb2312")) -> DataFrame:
    """path, text, status: ok, mojibake_in_utf8, wrong_encoding (read by a legacy codec) or unreadable."""

    @F.pandas_udf("struct<text:string,status:string>")
    def decode(content: pd.Series) -> pd.DataFrame:
        rows = []
        for b in content:
            for codec in ("utf-8", *codecs):
                try:
                    rows.append((b.decode(codec), "ok" if codec == "utf-8" else "wrong_encoding"))
                    break
                except UnicodeDecodeError:
                    continue
            else:
                rows.append((None, "unreadable"))
        return pd.DataFrame(rows, columns=["text", "status"])

    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", decode("content").alias("d")).select("path", "d.text", "d.status")
    return d.withColumn("status", F.when((F.col("status") == "ok") & T.mojibake(F.col("text")), "mojibake_in_utf8").otherwise(F.col("status")))


def read_json_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON by a given schema; a missing path is an empty table, a bad line a row of nulls."""
    try:
        return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(at, op, message) of ``## [date time] op | message`` lines."""
    line = r"^#{2} \[([0-9-]{10})(?: ([0-9:]{5}))?\] (\S+) \| (.*)$"
    return spark.read.text(path).where(F.col("value").rlike(line)).select(F.concat_ws(" ", F.regexp_extract("value", line, 1), F.nullif(F.regexp_extract("value", line, 2), F.lit(""))).alias("at"), F.regexp_extract("value", line, 3).alias("op"), F.regexp_extract("value", line, 4).alias("message"))


def last_run(log: DataFrame, op: str, as_of: str) -> DataFrame:
    """When an operation last ran, and how many days before ``as_of``."""
    return log.where(F.col("op") == op).agg(F.max("at").alias("at")).withColumn("age_days", T.age_days(F.col("at"), as_of))


def sample_heads(docs: DataFrame, n: int, seed: int = 7, lines: int = 10, chars: int = 300) -> DataFrame:
    """The first lines of n documents chosen at random, repeatably."""
    return docs.orderBy(F.rand(seed)).limit(n).select("path", F.left(F.array_join(F.slice(F.split("body", "\n"), 1, lines), "\n"), F.lit(chars)).alias("head"))


def read_pdf(spark: SparkSession, root: str, max_pages: int = 25) -> DataFrame:
    """path, text, pages, error of PDF files; without a PDF library every row says so."""

    def run(frames):
        try:
            import fitz
        except ImportError:
            fitz = None
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"], strict=True):
                if fitz is None:
                    rows.append((path, None, None, "no PDF library"))
                    continue
                try:
                    with fitz.open(stream=bytes(content), filetype="pdf") as doc:
                        rows.append((path, "\n".join(p.get_text() for p in list(doc)[:max_pages]), len(doc), None))
                except Exception as e:  # noqa: BLE001  (any damage is an error record)
                    rows.append((path, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "text", "pages", "error"])

    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.pdf").load(root).select("path", "content").mapInPandas(run, "path string, text string, pages int, error string")


def collected_urls(raw: DataFrame) -> DataFrame:
    return raw.where(F.length("source_url") > 0).select("company", "source_url").distinct()


def search_source(fetch):
    """A Python data source over ``fetch(query) -> list of dicts``; a failing query is one row with its error.

    Register with spark.dataSource.register; options: queries, newline-separated.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class One(InputPartition):
        def __init__(self, query):
            super().__init__(query)

    class Reader(DataSourceReader):
        def __init__(self, queries):
            self.queries = queries

        def partitions(self):
            return [One(q) for q in self.queries]

        def read(self, partition):
            try:
                hits = fetch(partition.value)
            except Exception as e:  # noqa: BLE001  (a search that fails is a result)
                yield (partition.value, None, None, None, None, str(e))
                return
            for h in hits:
                yield (partition.value, h.get("title"), h.get("url"), h.get("content"), h.get("published_date"), None)

    class Search(DataSource):
        @classmethod
        def name(cls):
            return "news_search"

        def schema(self):
            return "query string, title string, url string, content string, published_date string, error string"

        def reader(self, schema):
            return Reader([q for q in self.options.get("queries", "").split("\n") if q])

    return Search
