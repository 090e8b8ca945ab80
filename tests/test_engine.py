"""The engine's own operators: readers, text functions, routing, sinks, plans, streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from loomwright import rules as R
from loomwright.functions import text as T
from loomwright.operators import graph as G
from loomwright.operators import knowledge as K
from loomwright.plans import maintenance as M
from loomwright.sinks import writers as S
from loomwright.sources import readers as SRC
from loomwright.streaming import incremental as I

GRAPH = """
nodes:
  Chips: {type: sector, tier: 2, keywords: [GPU, wafer], parent_theme: [Compute]}
  Tools: {type: subsector, parent_sector: [Chips]}
  Compute: {type: theme}
companies:
  Acme: {ticker: ACM, sectors: [Chips], themes: [Compute], aliases: [Acme Works], competes_with: [Bolt]}
  Bolt: {ticker: 600001, exchange: SSE, sectors: [Chips]}
edges:
  - {from: Tools, to: Chips, type: belongs_to}
  - {from: Tools, to: Chips, type: upstream_of, label: feeds}
  - {from: Chips, to: Compute, type: upstream_of}
questions:
  Chips: ["How is wafer supply?"]
settings:
  name_blacklist: [Bolt]
  keyword_meta: {default_specificity: 0.5, specificity_overrides: {wafer: 0.2}}
"""


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("g") / "graph.yaml"
    p.write_text(GRAPH)
    return SRC.load_graph(spark, str(p))


def test_graph(spark, graph, tmp_path):
    assert graph["nodes"].count() == 3 and graph["settings"]["name_blacklist"] == ["Bolt"]
    assert {(r.keyword, r.entity) for r in SRC.keywords(graph["nodes"]).collect()} >= {("gpu", "Chips"), ("tools", "Tools")}
    keys = spark.createDataFrame([("ACM",), ("Acme Works",), ("Bolt",), ("nobody",)], "key string")
    assert {r.key: r.company for r in SRC.lookup(graph["companies"], keys).collect()} == {"ACM": "Acme", "Acme Works": "Acme", "Bolt": "Bolt"}
    (tmp_path / "empty.yaml").write_text("")
    assert SRC.load_graph(spark, str(tmp_path / "empty.yaml"))["edges"].count() == 0
    with pytest.raises(FileNotFoundError):
        SRC.load_graph(spark, str(tmp_path / "none.yaml"))
    assert [r.entity for r in G.upstream(graph["edges"], "Chips").collect()] == ["Tools"]
    assert [r.entity for r in G.downstream(graph["edges"], "Chips").collect()] == ["Compute"]
    assert {(r.sector, r.topic) for r in G.sector_topics(graph["nodes"], graph["edges"]).collect()} >= {("Chips", "Tools"), ("Chips", "Chips")}
    have = spark.createDataFrame([("Chips",), ("Bolt",), ("Compute",)], "entity string")
    assert {r.entity for r in G.related(graph["companies"], graph["nodes"], "Acme", have).collect()} == {"Chips", "Bolt", "Compute"}
    assert G.add_edge(graph["edges"], graph["edges"]).count() == 3


def test_paths_drop_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("b", "d")], "src string, dst string")
    start = spark.createDataFrame([("a",)], "entity string")
    assert [r.path for r in G.paths(e, start).collect()] == [["a", "b", "d"]]
    assert {r.entity: r.hops for r in G.reach(e, start).collect()} == {"a": 0, "b": 1, "c": 2, "d": 2}


def test_route(spark, graph):
    rules = R.with_settings(R.Rules(), graph["settings"])
    docs = spark.createDataFrame([(1, "the new gpu is out", ""), (2, "wafer only", ""), (3, "nothing", "ACM"), (4, "Acme and Bolt", ""), (5, "x" * 600 + " Acme Acme", "")], "doc int, text string, hint string")
    got = {(r.doc, r.entity): round(r.score, 2) for r in K.route(docs, graph, rules).collect()}
    assert got[1, "Chips"] == 0.35 and not [k for k in got if k[0] in (2, 5)]
    assert got[3, "Acme"] == 1.0 and got[3, "Chips"] == 0.8 and got[3, "Tools"] == 0.8
    assert got[4, "Acme"] == 0.3 and (4, "Bolt") not in got


def test_tokens_and_sections(spark):
    assert one(spark, T.tokens, "刻蚀设备 ABC_1中x") == ["刻蚀", "蚀设", "设备", "abc_1", "中", "x"]
    page = '---\ntitle: "A"\ntags: [x, y]\ntitle: B\n---\n# H\n\n## 时间线\n### 2024-01-02 | news | Big\n- point one\n- [来源](../raw/a.md)\n### 2024-01-01 | report | Old\ntext\n\n## 综合评估\n> fine\n'
    assert one(spark, T.frontmatter, page) == {"title": "B", "tags": "[x, y]"}
    e = one(spark, T.timeline, page)
    assert [(x.date, x.source_type, x.title, x.points, x.source_path) for x in e] == [("2024-01-02", "news", "Big", ["point one"], "../raw/a.md"), ("2024-01-01", "report", "Old", [], "")]
    assert one(spark, lambda c: T.section(c, "综合评估"), page).strip() == "> fine"
    assert one(spark, T.strip_frontmatter, page).startswith("\n# H")
    assert one(spark, T.list_value, "[a, 'b']") == ["a", "b"]


def test_text_functions(spark):
    assert one(spark, T.clean_markdown, "# T\n![i](u) [a](b) [[x|y]] **z**") == "T a y z"
    assert one(spark, T.sentences, "第一句话比较长一点哦哦哦。Second sentence here. Third one is here") == ["第一句话比较长一点哦哦哦。", "Second sentence here", "Third one is here"]
    assert one(spark, T.normal_path, "a\\b/../c/./d") == "a/c/d"
    assert one(spark, lambda c: T.inject_links(c, F.array(F.lit("AB"), F.lit("ABC"))), "---\nABC: 1\n---\nABC and AB [[Q]]").startswith("---\nABC: 1\n---\n[[")
    assert one(spark, T.wikilinks, "[[a|b]] [[a]] [[c]]") == ["a", "c"]
    assert one(spark, T.answer_type, "compare x and y") == "comparison" and one(spark, T.sentiment, "strong growth, one loss") == "positive"
    assert one(spark, lambda c: T.json_in(c).cast("string"), 'x ```json\n{"a": 1}\n```') == '{"a":1}' and one(spark, lambda c: T.json_in(c).cast("string"), "none") is None
    assert one(spark, lambda c: T.mentions(c, F.lit("aa")), "aaaa") == 2
    assert one(spark, lambda c: T.file_type(c)["type"], "2024半年报.pdf") == "semi_annual_report"
    assert one(spark, lambda c: T.classify_path(c)["type"], "/x/prospectus/foo.bin") == "prospectus"
    assert one(spark, T.query_keywords, "芯片 供应 how?") == ["芯片", "供应"]
    q = one(spark, T.quality, "NVIDIA announced 30% growth in 2024. " * 20)
    assert q.grade in "SAB" and q.action == "accept" and "numbers" in q.reasons
    assert one(spark, T.quality, None).action == "reject" and one(spark, T.quality, "short").grade == "C"
    s = one(spark, T.summary, "Revenue grew 12% in 2024 across the group. Weather was mild today in town. CEO announced new GPU capacity.")
    assert len(s.points) == 3 and s.quality == "high"
    assert [one(spark, lambda c, v=v: T.mojibake(c, v), "ÀÁÂ") for v in ("default", "strict", "ipa", "loose")] == [False, False, True, True]


def test_rules(tmp_path):
    p = tmp_path / "r.yaml"
    p.write_text("low_quality_sources:\n  url_patterns: [bad.com]\nnoise_patterns: ['ok', '(']\nquality_grading:\n  weights: {content_length: 0.9}\n")
    r = R.load_rules(str(p))
    assert r.url_blacklist == ("bad.com",) and r.noise == ("ok",) and r.weights["content_length"] == 0.9
    assert R.load_rules(str(tmp_path / "none")) == R.Rules()
    c = R.OpsConfig.load(None, {"KB_RETRIES": "5", "KB_DRY_RUN": "yes", "KB_SEARCH_DAYS": "x"})
    assert (c.retries, c.dry_run, c.search_days) == (5, True, 7)


def test_readers(spark, tmp_path):
    wiki = tmp_path / "companies" / "Acme" / "wiki"
    wiki.mkdir(parents=True)
    (wiki / "news.md").write_text("---\ntitle: News\nsources_count: x\n---\n[[Nowhere]] [[News]]\n")
    raw = tmp_path / "companies" / "Acme" / "raw"
    raw.mkdir()
    (raw / "a.md").write_text("---\ntitle: T\ncompany: Acme\nsource_url: http://u\n---\nbody\n")
    (raw / "g.txt").write_bytes("中文".encode("gbk"))
    pages = SRC.read_pages(spark, str(tmp_path))
    assert [(r.entity, r.topic, r.sources_count) for r in pages.collect()] == [("Acme", "news", None)]
    d = SRC.read_raw(spark, str(tmp_path)).first()
    assert (d.title, d.company, d.body.strip()) == ("T", "Acme", "body")
    assert {os.path.basename(r.path): r.status for r in SRC.read_any_encoding(spark, str(raw)).collect()} == {"a.md": "ok", "g.txt": "wrong_encoding"}
    assert [r.target for r in K.broken_links(pages, pages.select(F.col("title").alias("target"))).collect()] == ["Nowhere"]
    assert SRC.read_json_or_empty(spark, str(tmp_path / "no.json"), "a int").count() == 0
    log = tmp_path / "log.md"
    log.write_text("## [2024-01-01 10:00] collect | x\n- d\n## [2024-01-03] lint | y\n")
    assert SRC.last_run(SRC.read_log(spark, str(log)), "collect", "2024-01-05").first().age_days == 4
    spark.dataSource.register(SRC.search_source(lambda q: [{"title": q, "url": "u"}] if q != "bad" else 1 / 0))
    found = {r["query"]: (r.title, r.error) for r in spark.read.format("news_search").option("queries", "a\nbad").load().collect()}
    assert found["a"] == ("a", None) and found["bad"][0] is None and "zero" in found["bad"][1]


def test_ingest_and_sinks(spark, graph):
    rules = R.with_settings(R.Rules(), graph["settings"])
    body = "NVIDIA announced 30% growth of GPU wafer output in 2024 at the plant. " * 5
    raw = spark.createDataFrame([("p1", "Big GPU news", "ACM", "http://ok", "2024-01-01", body, "m1"), ("p2", "copy", "ACM", "http://ok", "2024-01-01", body, "m1"), ("p3", "t", None, "http://quote.x", "2024-01-01", body, "m2"), ("p4", "t", None, None, None, "tiny", "m3"), ("p5", "old", None, None, None, body, "m0")], "path string, title string, company string, source_url string, published_date string, body string, md5 string")
    out = M.ingest(raw, spark.createDataFrame([("m0",)], "md5 string"), graph, rules)
    assert {r.path: r.reason for r in out["skipped"].collect()} == {"p3": "blacklist", "p4": "too short"}
    assert {r.entity for r in out["entries"].collect()} >= {"Acme", "Chips"} and {r.md5 for r in out["ledger"].collect()} == {"m1", "m2", "m3"}
    timeline = out["entries"].limit(0)
    new = S.upsert_timeline(timeline, out["entries"])
    assert new.count() == out["entries"].count() and S.upsert_timeline(new, out["entries"]).count() == 0
    assert S.page_stats(new).where("sources_count = 1").count() == new.count()
    assert any(json.loads(r.json)["kind"] == "edge" for r in S.graph_json(graph["nodes"], graph["companies"], graph["edges"]).collect())
    assert S.catalogue_page(graph["companies"], graph["nodes"]).first().companies == "Acme, Bolt"


def test_cleaning_and_contradictions(spark):
    t = spark.createDataFrame([("E", "t", "d1", "A", ["long enough point here"], "body", 0, "x", ""), ("E", "t", "d1", "A", ["long enough point here"], "longer body", 1, "x", ""), ("E", "t", "d2", "B", [], "b", 2, "x", ""), ("E", "t", "d3", "年报", ["short but not a title at"], "b", 3, "x", "")], "entity string, topic string, date string, title string, points array<string>, body string, pos int, path string, source_path string")
    out = M.clean_timeline(t)
    assert [r.body for r in out["kept"].collect() if r.date == "d1"] == ["longer body"] and {r.why for r in out["rejected"].where("date = 'd2'").collect()} == {"title dump"}
    v = spark.createDataFrame([("e", "m", x) for x in (10.0, 10.0, 6.9, 7.0, 7.1, -1.0)], "entity string, metric string, value double")
    assert K.numeric_contradictions(v).first().n_pairs == 2
    s = spark.createDataFrame([("e", "2024-01-01", "p", 0, ["a", "b", "c"]), ("e", "2024-01-02", "q", 0, ["a", "b"]), ("e", "2024-01-03", "r", 0, ["z"])], "entity string, date string, page string, pos int, words array<string>")
    assert [(r.page, r.other_page) for r in K.temporal_contradictions(s).collect()] == [("p", "q")]
    done = M.complete(spark.createDataFrame([(1, "hi")], "id int, prompt string"), lambda p: 1 / 0, retries=0).first()
    assert not done.success and M.complete(spark.createDataFrame([(1, "hi")], "id int, prompt string")).first().content == "hi"
    M.register(spark)
    assert spark.sql("SELECT kb_strip_tags('<b>x</b>  y') AS t").first().t == "x y"


def test_incremental_stream(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    os.makedirs(src)

    def put(name, *lines):
        with open(f"{src}/{name}", "w") as f:
            f.write("\n".join(lines))

    put("1.json", '{"path": "a", "text": "x"}', '{"path": "b", "text": "x"}', "broken")
    I.ingest_new(spark, src, out, ck).awaitTermination()
    put("2.json", '{"path": "c", "text": "x"}', '{"path": "d", "text": "y"}')
    I.ingest_new(spark, src, out, ck).awaitTermination()
    assert sorted(r.path for r in spark.read.parquet(f"{out}/docs").collect()) == ["a", "d"]


def test_search_and_questions(spark):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, "green")], "doc int, text string")
    p, df = K.index(docs)
    assert [r.doc for r in K.search(p, df, "red", 5).collect()] == [1]
    q = spark.createDataFrame([("E", "red fox?"), ("E", "purple?")], "entity string, question string")
    d = docs.withColumn("entity", F.lit("E"))
    assert {(r.doc, r.confidence) for r in K.question_matches(q, d).collect()} == {(1, "high"), (2, "medium")}
    assert [r.question for r in K.unanswered(q, d.withColumnRenamed("text", "content")).collect()] == ["purple?"]
    assert K.snippet(docs, ["fox"]).where("doc = 1").first().snippet == "red fox red"


def test_paths_are_whole(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(0, 39)], "src int, dst int")
    start = spark.createDataFrame([(0,)], "entity int")
    assert sorted(r.n for r in G.paths(chain, start).collect()) == [3, 41]
    assert G.find_path(chain, 0, 40).first().path == [0, 39, 40] and G.find_path(chain, 0, 20).count() == 0
    assert G.find_path(chain, 0, 0).first().hops == 0 and G.find_path(chain, 5, 1).count() == 0


def test_contradictions_between_pages(spark):
    """30 and 50 per cent contradict, 85 and 90 don't; not within one page, nor about different firms."""
    pages = spark.createDataFrame([("E", "p1", "份额 30% 和 85%"), ("E", "p2", "份额 50%，又 90%"), ("F", "p1", "10% 然后 90%"), ("G", "p1", "甲乙公司 10%"), ("G", "p2", "丙丁公司 90%"), ("G", "p3", "无名 50 %"), ("H", "p1", None), ("I", "p1", "3台 和 9片")], "entity string, page string, content string")
    v = K.statements(pages)
    assert {(r.metric, r.value) for r in v.where("entity = 'I'").collect()} == {("数量（台）", 3.0), ("数量（片）", 9.0)}
    assert {r.about for r in v.where("entity = 'G'").collect()} == {"甲乙公司", "丙丁公司", ""}
    got = {r.entity: r.n_pairs for r in K.numeric_contradictions(v).collect()}
    # E: 30-50, 30-90, 85-50; G: 10-50 and 90-50, as p3 names no firm.
    assert got == {"E": 3, "G": 2}
    text = "x" * 50 + "12%\n" + "y" * 50
    assert K.statements(spark.createDataFrame([("E", "p", text)], "entity string, page string, content string")).first().statement == "x" * 30 + "12% " + "y" * 29


def test_containing_and_cross_references(spark):
    d = spark.createDataFrame([(1, "abcab"), (2, ""), (3, None), (4, "xyz")], "doc int, text string")
    w = spark.createDataFrame([("ab", 1), ("b", 2), ("", 3), ("ab", 4)], "w string, k int")
    assert sorted((r.doc, r.w, r.k) for r in K.containing(d, w, "text", "w").collect()) == [(1, "ab", 1), (1, "ab", 4), (1, "b", 2)]
    assert K.containing(d, w.limit(0), "text", "w").count() == 0


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox red"), (2, "blue fox"), (3, ""), (4, None)], "doc int, text string")
    path = f"file://{tmp_path}/index"
    assert K.load_index(spark, path) is None
    K.save_index(docs, path)
    at = K.load_index(spark, path)
    assert [tuple(r) for r in K.search(at["postings"], at["df"], "red fox", 5, at["norms"]).collect()] == [tuple(r) for r in K.search(*K.index(docs), "red fox", 5).collect()]


def test_links_to_markdown(spark):
    page = "[[A]] `[[A]]` [[x/B|shown]] ```\n[[A]]\n``` [[none]] [plain](u) [[A"
    m = F.create_map(F.lit("A"), F.lit("c/a b.md"), F.lit("B"), F.lit("b.md"))
    assert one(spark, lambda c: T.links_to_markdown(c, m, F.lit("w/p.md")), page) == "[A](../c/a%20b) `[[A]]` [shown](../b) ```\n[[A]]\n``` [[none]] [plain](u) [[A"
    related = lambda c: T.related_section(c, F.array(F.lit("N")))
    assert one(spark, related, "a") == "a\n\n## 相关页面\n\n- [[N]]\n" and one(spark, related, one(spark, related, "a")) == "a\n\n## 相关页面\n\n- [[N]]\n"
    assert one(spark, related, "a\n## 相关页面\n\n- [[O]]\n## Z\nb") == "a\n## 相关页面\n\n- [[N]]\n\n## Z\nb"


def test_long_timeline(spark):
    page = "## 时间线\n### d | s | t\n" + "\n".join(f"- p{i}" for i in range(100_005))
    assert one(spark, lambda c: F.size(T.timeline(c)[0]["points"]), page) == 100_005


def test_completion_by_model_or_rule(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, text string")
    got = lambda **k: {r.id: (r.content, r.by) for r in M.complete_or_rule(rows, "summarise", F.upper("text"), interval=0, **k).collect()}
    assert got() == {"1": ("GOOD", "rule"), "2": ("BAD", "rule")}
    assert got(completer=lambda p: "said " + p.split("\n")[-1], valid=lambda c: c.contains("good")) == {"1": ("said good", "model"), "2": ("BAD", "rule")}
    entries = "".join(f"### 2024-01-0{i} | news | T{i}\n- a point of some length {i}\n" for i in range(1, 4))
    pages = spark.createDataFrame([("p", f"## 时间线\n{entries}\n## 综合评估\n"), ("q", "## 时间线\n")], "path string, content string")
    assert [(r.path, r.by) for r in M.enrich(pages, R.Rules()).collect()] == [("p", "rule")]
    M.timed.rows.clear()
    with pytest.raises(ZeroDivisionError), M.timed("step", kind="x"):
        1 / 0
    assert [r[:2] for r in M.timed.rows] == [("timer", "step"), ("counter", "step.errors")]


def test_inbox_and_command_line(spark, tmp_path, capsys):
    from loomwright import __main__, shared

    (tmp_path / "_inbox").mkdir()
    for n in ("b.md", "a.md"):
        (tmp_path / "_inbox" / n).write_text("---\ntitle: x\n---\nbody\n")
    assert [r.name for r in SRC.read_inbox(spark, str(tmp_path)).collect()] == ["a.md", "b.md"]
    assert spark.range(1).select(SRC.place(F.lit("companies"), F.lit("A"), F.lit("t"), "/w/")).first()[0] == "/w/companies/A/wiki/t.md"
    __main__.main([])
    assert "route_documents" in capsys.readouterr().out
    assert shared.folder(spark).startswith(shared.base(spark) + "/")


def test_char_similar(spark):
    """Whole texts, against brute force; alphabets of one word of bits and of many, sets that differ by level, copies."""
    import random

    from loomwright.operators.char_sets import char_sets, char_similar, differ

    rng = random.Random(3)
    texts = [None, "", "a", "aa", "x" * 600 + "é", "x" * 700]
    for size, first, spread in ((12, 97, 26), (22, 97, 40), (45, 97, 60), (70, 0x4E00, 100), (150, 0x4E00, 400), (30, 0x1F600, 40)):
        for _ in range(8):
            base = rng.sample([chr(first + i) for i in range(spread)], size)
            for change in (0, 0, 1, 1, 2, 3, 4, 6, 8):
                t = base[change // 2 :] + [chr(first + spread + rng.randrange(9)) for _ in range(change - change // 2)]
                rng.shuffle(t)
                texts.append("".join(t) * 3)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for percent in (95, 80):
        got = {r.doc_id: (r.class_id, r.n_similar) for r in char_similar(char_sets(d), percent).collect()}
        sets = {i: frozenset(t) for i, t in enumerate(texts) if t}
        want = {i: (min(j for j, o in sets.items() if o == s), sum(j != i and 100 * len(s & o) > percent * len(s | o) for j, o in sets.items())) for i, s in sets.items()}
        assert got == want and any(n > 3 for _, n in got.values())
    assert [differ(z, 95) for z in (1, 19, 20, 38, 39)] == [0, 0, 1, 1, 2]
