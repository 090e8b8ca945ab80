"""Line dedup: an exact set-similarity join of lines, which removes later matches.

A line is a \\n-separated part of a text; its set is its distinct words (runs
of anything but ASCII blanks, compared as they are).  Every line with a word
takes part.  A line goes when an earlier line of the corpus, removed or not,
has Jaccard similarity of at least ``percent`` per cent with it; earlier is by
(doc_id, line number).

Lines of equal sets form a class, wherever they are; classes are joined by the
machinery of the n-gram join: tokens in order of rarity over the whole corpus,
prefix, length and positional filters, exact verification.  Sets of so few
words that only equal ones are similar (under 4 at 80 %) are classes only.

1. Survey, one scan: per pack of documents and class, the first position there
   and how many lines it has; and the words' frequencies.
2. One query: packs are shuffled once, with each line's class beside the text;
   classes are joined, and each has one position, its own and its matches'
   earliest, which goes back to the packs that hold the class.  However often a
   line occurs, it moves once per pack.

Defined cases: a null or empty text has no lines with words and stays as it
is; blank lines are never removed; a null doc_id comes after all others;
rows of the same doc_id aren't earlier or later than each other, line for
line, so repeated rows keep the same lines; a text of any length is read whole.
A doc_id must be a number: another type is cast, and what can't be cast raises.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from . import core
from . import ngram_join as nj
from .bpe import _unzip, _zip
from .fertility import LINE

U = np.uint64
LAST = np.iinfo(np.int64).max
SHARE = 2
#: Prefixes of lines are short, so that combinations of two of their tokens are few.
FREQUENT, FLOOR = 1 / 1024, 64
SCHEMA = "doc_id long, n_lines long, n_removed long, kept_sha256 string"


class Lines:
    """Word sets of the lines of a chunk of documents; as nj.Sets, with lines for documents."""

    def __init__(self, buf, off):
        self.starts, self.ends = core.spans(buf, off, LINE)
        starts, ends = core.spans(buf, off, core.NONBLANK)
        tokens = core.hashes(buf, starts, ends)
        line = np.repeat(np.arange(len(self.starts)), np.diff(np.append(np.searchsorted(starts, self.starts), len(starts))))
        o = core.distinct_in(line, tokens)
        self.tokens, self.doc = tokens[o], line[o]
        self.bounds = np.searchsorted(self.doc, np.arange(len(self.starts) + 1))
        self.size = np.diff(self.bounds)
        c = np.concatenate((np.zeros(1, U), np.cumsum(core.mix(self.tokens + U(77)), dtype=U)))
        self.cls = np.where(self.size > 0, core.mix(c[self.bounds[1:]] - c[self.bounds[:-1]] + self.size.astype(U)), U(0))


def places(buf, off, starts):
    """(owner, number) of the lines that begin at ``starts``; numbers count blank and empty lines too."""
    breaks = np.concatenate(([0], np.cumsum(buf == 10))) if len(buf) else np.zeros(1, np.int64)
    owner = core.word_docs(core.per_doc(off, starts), len(starts))
    return owner, breaks[starts] - breaks[off[:-1]][owner] if len(starts) else np.zeros(0, np.int64)


def _ids(batch):
    col = batch.column(batch.schema.get_field_index("doc_id"))
    return col.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _rows_of(block):
    with pa.ipc.open_stream(block) as r:
        return list(r)


def in_packs(batches):
    """(batches, key) of packs of bounded size; the key stands for the ids and texts."""
    held, used, name = [], 0, hashlib.blake2b(digest_size=16)
    for batch, buf, off in core.chunks(batches):
        held.append(batch)
        used += len(buf) + 64 * batch.num_rows
        for x in (_ids(batch), off, buf):
            name.update(np.ascontiguousarray(x))
        if used > nj.PACK:
            yield held, name.digest()
            held, used, name = [], 0, hashlib.blake2b(digest_size=16)
    if held:
        yield held, name.digest()


SURVEY = "at long, cls long, doc long, line long, n long, " + nj.Tally.schema


def survey(docs, bits):
    """Per pack (by where its texts are grouped) and class: its first position there and how many lines it has; and the tasks' counters."""
    fields = [x.split()[0] for x in SURVEY.split(", ")]

    def rows(at, *cols):
        n = len(cols[0])
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, at)), *map(pa.array, cols), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=fields)

    def run(batches):
        tally = nj.Tally(bits)
        for held, name in in_packs(batches):
            cls, doc, number = [], [], []
            for batch, buf, off in core.chunks(held):
                s = Lines(buf, off)
                tally.add(s.tokens)
                owner, n = places(buf, off, s.starts)
                have = s.size > 0
                cls.append(s.cls[have]), doc.append(_ids(batch)[owner[have]]), number.append(n[have])
            cls, doc, number = (np.concatenate(x) for x in (cls, doc, number))
            o = np.lexsort((number, doc, cls))
            cls, doc, number = cls[o], doc[o], number[o]
            first = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1]))) if len(cls) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(cls)))
            yield rows(nj.at_of(name), cls[first].view(np.int64), doc[first], number[first], n)
            # Every pack has a row, so that one that gets no answer is found out.
            yield rows(nj.at_of(name), *(np.array([x], np.int64) for x in (0, LAST, LAST, 0)))
        for number, block in tally.blocks():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 5 + [pa.array([number], pa.int32()), pa.array([block], pa.binary())], names=fields)

    return docs.mapInArrow(core.lean(run), SURVEY)


def packs(parts: int, percent: int, order_b):
    """Packs as in the n-gram join; a pack's texts are its rows, and each line's class (0: no word)."""

    def rows(batches, name):
        every, size, hot, sig, got, base, seen = [], [], [], [], [], 0, np.zeros(0, U)
        for _, buf, off in core.chunks(batches):
            s = Lines(buf, off)
            use = np.zeros(len(s.cls), bool)
            use[np.unique(s.cls, return_index=True)[1]] = True
            use &= (s.size > 0) & ~np.isin(s.cls, seen)
            seen = np.union1d(seen, s.cls[use])
            found, h = nj.indexed(s, order_b.value, percent, SHARE, use)
            got += [(t, d + base, p) for t, d, p in found]
            base += len(s.cls)
            every.append(s.cls), size.append(s.size), hot.append(h), sig.append(nj.signature(s))
        every, size, hot, sig = (np.concatenate(x) for x in (every, size, hot, sig))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batches[0].schema) as w:
            for b in batches:
                w.write_batch(b)
        return nj.packed_rows(name, _zip(sink.getvalue(), every), nj.blocks_of(got, (every, size, hot, sig), parts))

    def run(batches):
        for held, name in in_packs(batches):
            yield rows(held, name)

    return run


def _with_lines(block):
    """(batch, bytes, offsets, lines' starts, ends, classes) of a pack's texts, in chunks."""
    rows, cls = _unzip(block)
    cls, at = np.frombuffer(cls, U), 0
    for batch, buf, off in core.chunks(_rows_of(rows)):
        starts, ends = core.spans(buf, off, LINE)
        yield batch, buf, off, starts, ends, cls[at : at + len(starts)]
        at += len(starts)


def asked_lines(block, asked):
    """Of a pack's lines, the sets of the classes that are asked for."""
    for _, buf, _, starts, ends, cls in _with_lines(block):
        mine = np.flatnonzero(core.member(cls, asked))
        mine = mine[np.unique(cls[mine], return_index=True)[1]]
        if len(mine):
            n = (ends - starts)[mine]
            yield Lines(buf[core.ragged(starts[mine], n)], np.concatenate(([0], np.cumsum(n))))


def _run(docs, percent, frequent, floor, bits, row, schema):
    """row(batch, texts kept, numbers of lines, numbers removed) makes the result's batches."""
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    surveyed = core.save(survey(docs, bits))
    who = surveyed.where("slice IS NULL").select("at", "cls", "doc", "line", "n")
    n_sets = who.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    order = spark.sparkContext.broadcast(nj.Order(nj.levels(surveyed.where("slice IS NOT NULL").select("slice", "block"), bits), n_sets, frequent, floor))
    parts = core.parts(docs)
    packed = docs.mapInArrow(core.lean(packs(parts, percent, order)), nj.SCHEMA_AT).repartition(core.partitions(spark), "at")
    links = nj.linked(packed, parts, asked_lines, percent, SHARE)
    at = F.struct("doc", "line")
    per = who.where("n > 0").groupBy("cls").agg(F.min(at).alias("first"), F.sum("n").alias("n"))
    ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
    before = ends.join(per.select(F.col("cls").alias("b"), "first"), "b").groupBy(F.col("a").alias("cls")).agg(F.min("first").alias("other"))
    # Classes of one line that match nothing need no answer.
    cut = per.join(before, "cls", "left").where("n > 1 OR other IS NOT NULL").select("cls", F.least("first", F.coalesce("other", "first")).alias("cut"))
    answers = who.where("n > 0").select("at", "cls").join(cut, "cls").select("at", "cls", F.col("cut.doc").alias("doc"), F.col("cut.line").alias("line"))
    answers = answers.unionByName(who.where("n = 0").select("at", "cls", "doc", "line"))

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = [b for p, b in zip(left.column("part").to_pylist(), left.column("block").to_pylist(), strict=True) if p == -1]
        if bool(blocks) != bool(right.num_rows):
            raise RuntimeError("the lines of a pack changed while they were joined; the input isn't repeatable")
        cls = np.array(right.column("cls")).astype(np.int64).view(U)
        o = np.argsort(cls)
        cls, doc, line = cls[o], np.array(right.column("doc"))[o], np.array(right.column("line"))[o]
        out = []
        for block in blocks:
            for batch, buf, off, starts, _, mine in _with_lines(block):
                owner, number = places(buf, off, starts)
                ids = _ids(batch)
                gone = np.zeros(len(mine), bool)
                f = np.flatnonzero(core.member(mine, cls) & (mine != 0))
                k = np.searchsorted(cls, mine[f])
                i = ids[owner[f]]
                gone[f] = (doc[k] < i) | ((doc[k] == i) & (line[k] < number[f]))
                raw, texts = buf.tobytes(), []
                bounds = core.per_doc(off, starts)
                removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[bounds]).tolist()
                breaks = np.concatenate(([0], np.cumsum(buf == 10)))[off]
                lines = np.where(np.diff(off) > 0, np.diff(breaks) + 1, 0).tolist()
                for d, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    text = raw[a:b]
                    if removed[d]:
                        x = slice(bounds[d], bounds[d + 1])
                        drop = set(number[x][gone[x]].tolist())
                        text = b"\n".join([p for i, p in enumerate(text.split(b"\n")) if i not in drop])
                    texts.append(text)
                out.append(row(batch, texts, lines, removed))
        return pa.Table.from_batches(out) if out else row(None, [], [], [])

    return packed.groupBy("at").cogroup(answers.groupBy("at")).applyInArrow(core.lean(each), schema)


def digests(docs, percent: int = 80, frequent: float = FREQUENT, floor: int = FLOOR, bits: int = 22):
    """doc_id, n_lines, n_removed and the SHA-256 of the text without the removed lines."""

    def row(batch, texts, lines, removed):
        ids = batch.column(0) if batch is not None else pa.array([], pa.int64())
        x = pa.RecordBatch.from_arrays([ids, pa.array(lines, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])
        return x if batch is not None else pa.Table.from_batches([x])

    return _run(core.docs_of(docs), percent, frequent, floor, bits, row, SCHEMA)


def clean(docs, percent: int = 80, frequent: float = FREQUENT, floor: int = FLOOR, bits: int = 22):
    """The documents, all columns, without the removed lines.

    A document is dropped when every word it had was in a removed line; one
    that had none from the start stays.  ``n_chars``, where there is such a
    column, is the new text's length.
    """
    names, ti = docs.columns, docs.columns.index("text")
    ci = names.index("n_chars") if "n_chars" in names else None

    def row(batch, texts, lines, removed):
        if batch is None:
            return empty
        keep = [not r or bool(t.split()) for t, r in zip(texts, removed, strict=True)]
        old = batch.column(ti)
        text = pa.array([t.decode() for t in texts], pa.large_string())
        if old.null_count:
            text = pa.compute.if_else(old.is_valid(), text, pa.scalar(None, pa.large_string()))
        cols = list(batch.columns)
        cols[ti] = text.cast(old.type)
        if ci is not None:
            changed = pa.array([bool(r) for r in removed])
            cols[ci] = pa.compute.if_else(changed, pa.compute.utf8_length(text).cast(cols[ci].type), cols[ci])
        return pa.RecordBatch.from_arrays(cols, names=names).filter(pa.array(keep, pa.bool_()))

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(docs.schema).empty_table()
    return _run(docs, percent, frequent, floor, bits, row, docs.schema)


QUERY = "op5_line_dedup"


def query(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(doc_id, 9223372036854775807) AS o, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, o, i - 1 AS i, ls[i] AS t FROM (SELECT r, o, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
s AS (SELECT r, o, i, list_sort(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS w FROM l),
c AS (SELECT w, min((o, i)) AS first, len(w) AS n, row_number() OVER () AS c FROM s WHERE len(w) > 0 GROUP BY w),
t AS (SELECT c, n, unnest(w) AS x FROM c),
p AS (SELECT a.c AS a, b.c AS b FROM t a JOIN t b ON a.x = b.x AND a.c <> b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
      GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
q AS (SELECT p.a AS c, min(c.first) AS other FROM p JOIN c ON c.c = p.b GROUP BY p.a),
cut AS (SELECT c.w, least(first, coalesce(other, first)) AS cut FROM c LEFT JOIN q USING (c)),
m AS (SELECT s.r, s.i, coalesce(cut.cut < (s.o, s.i), false) AS gone FROM s LEFT JOIN cut USING (w)),
k AS (SELECT m.r, CAST(count_if(gone) AS BIGINT) AS n_removed, coalesce(string_agg(l.t, chr(10) ORDER BY l.i) FILTER (WHERE NOT gone), '') AS kept FROM m JOIN l USING (r, i) GROUP BY m.r)
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(ls) END AS n_lines, n_removed, sha256(kept) AS kept_sha256 FROM d JOIN k USING (r)
"""
