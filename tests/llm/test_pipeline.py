"""The pipeline's stages against brute force over what each was given."""

import hashlib
from collections import Counter

import corpus_pipeline as P
from loomwright.llm import core, decontaminate, lines, ngram_join, toxicity

from .test_operators import brute_decontamination, brute_lines, brute_ngrams, labelled, rows


def test_stages(spark, tmp_path):
    data, marks = labelled()
    every = [(i, t, "en", "s", 1) for i, t, _ in data] + [(1000 + i, t, lang, "s", 1) for i, t, lang, _, _ in rows() if i is not None and i not in (41,)]
    bench = [(1, rows()[36][1]), (2, rows()[36][1][:200]), (3, None)]
    spark.createDataFrame(every, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = core.save(stage(spark, docs, str(tmp_path)))
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == P.COLUMNS or name == P.STAGES[-1][0]
        seen[name] = (before, after)
    assert [n for n, _ in P.STAGES] == list(seen) and len(P.STAGES) == 5
    before, after = seen["toxicity"]
    toxic = {i for i, _, t in marks if t}
    assert len(toxic & set(after)) <= 3 and len(after) >= len(every) - len(toxic) - 8
    before, after = seen["line dedup"]
    for i, _, removed, _ in brute_lines(before):
        assert i in after if not removed else True
    before, after = seen["n-gram Jaccard join"]
    assert set(after) == {i for i, _, _, c in brute_ngrams(before) if i == c}
    before, after = seen["benchmark decontamination"]
    assert set(after) == {r[0] for r in brute_decontamination(before, bench) if not r[5]}
    before, after = seen["byte-level BPE"]
    assert Counter(i for i, _ in before) == Counter(after.keys())
    whole = {r.doc_id: r.decoded_sha256 for r in P.run(spark, str(tmp_path)).collect()}
    assert whole == {i: r.decoded_sha256 for i, r in after.items()}
    assert decontaminate and lines and ngram_join and toxicity


def test_benchmark_stage_acts_on_one_item(spark, tmp_path):
    item = "Which of these nine rivers, says the old map, runs north of the grey hills?"
    before, after = "Some words é stand before.\n", "\nAnd others follow it to the end."
    docs = [(1, before + item + after), (2, before + after), (3, item), (4, before + item[: item.index("says")] + after), (5, None), (6, "")]
    spark.createDataFrame([(7, item), (8, "no document has a single one of these words together in it")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: (r.text, r.n_chars) for r in P.benchmark_stage(spark, docs, str(tmp_path)).collect()}
    cut = before + "?" + after
    whole = before + item[: item.index("says")] + after
    assert out == {1: (cut, len(cut)), 2: (before + after, len(before + after)), 4: (whole, len(whole)), 5: (None, 0), 6: ("", 0)}


def test_awkward_rows_and_empty_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, clashing columns; and no rows at all."""
    data, marks = labelled()
    every = [(i, t, "en", "s", 1, "x") for i, t, _ in data[:120]] + [(1000 + i if i is not None else None, t, lang, None, None, "x") for i, t, lang, _, _ in rows() if not t or len(t) < 9000]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _class_ string"
    for name, docs, labels, bench in (("some", every, marks, [(1, rows()[36][1]), (None, None)]), ("none", [], [], [])):
        at = f"{tmp_path}/{name}"
        spark.createDataFrame(docs, schema).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        left, given = spark.read.parquet(f"{at}/documents.parquet"), []
        for stage, f in P.STAGES:
            given.append(left)
            left = core.save(f(spark, left, at))
            assert left.columns == P.COLUMNS or stage == P.STAGES[-1][0]
        if not docs:
            assert left.count() == 0
            continue
        # Line dedup, compared whole: documents that keep a word, or had none, with the lines that stay.
        before = [(r.doc_id, r.text) for r in given[1].collect()]
        kept = Counter((r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in given[2].collect())
        expected = Counter()
        for (i, t), (_, _, removed, digest) in zip(before, brute_lines(before), strict=True):
            expected[i, digest] += 1
        assert not kept - expected and sum(kept.values()) >= sum(1 for _, _, removed, _ in brute_lines(before) if not removed)
        # n-grams: of each group one stays; the empty set is no group.
        before = [(r.doc_id, r.text) for r in given[2].collect()]
        ids = {i for i, n, _, c in brute_ngrams(before) if n and i == c and i is not None}
        assert ids <= {r.doc_id for r in given[3].collect()} and {None, 1000, 1001} <= {r.doc_id for r in given[3].collect()} | {None}
        assert Counter(r.doc_id for r in given[4].collect()) == Counter(r.doc_id for r in left.collect())
        assert {r.doc_id for r in P.run(spark, at).collect()} == {r.doc_id for r in left.collect()}
