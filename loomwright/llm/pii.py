"""Personal data: base patterns, and bootstrapped contextual extraction.

Base kinds (email, ip, card, phone) are found in every whole text.  Their
places are proposed by vector operations on the bytes (an @, a +, close
digits), and only there a regular expression runs; the result is that of the
expression over the whole text, leftmost and without overlaps.

The method finds identifiers that no base expression describes.  An *instance*
is a word that looks like an identifier (a digit, and at least ``least``
letters, digits and marks), or a base entity.  A *pattern* is lexical: the two
or three pieces before it (a piece is a word or one mark; words with digits
are alike, a text's end is a piece), the two before and one after, or one
before and one after.  *Seeds* are the base entities, and secrets: instances of
20 or more letters and digits that change between the two six times or more.
A secret alone is no finding; its context must be.

1. One scan: base spans per document, and each instance with its four patterns.
2. Patterns with at least ``support`` different instances go into a bitmap of
   fixed size, with which a second scan counts everything that follows them,
   identifier or not.  A pattern is eligible if at least half are instances.
3. Rounds over the graph of eligible patterns and their instances:

   * pattern score: summed belief in its n instances / (n + 1).  It qualifies with
     a score of at least ``precision``, and ``support`` instances believed by half;
   * belief: 1 for a seed; for another the best score of its qualifying patterns,
     where for scoring a pattern its own is left out.

   So what a pattern finds lets other patterns qualify in the next round, which
   find more.
4. Every instance behind a pattern that qualifies in the last round is a span,
   of the kind of most that the pattern's believed instances are.

Graph edges are aggregated before they are shuffled, and the rounds' tables
lie in the shared folder.

Defined cases: a null or empty text has no spans; offsets are code points, end
exclusive; an added span that overlaps a base span is left out; null doc_ids
keep their rows; repeated rows each get their own result row with all spans.
A doc_id must be a number: another type is cast, and what can't be cast raises.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa

from . import core
from .bpe import _unzip, _zip

U = np.uint64
KINDS = ("email", "ip", "card", "phone", "secret")
SECRET = 4
#: Marks that may stand inside an identifier.
MARKS = b"._%+@:/#-"
EMAIL_RUN = np.zeros(256, bool)
EMAIL_RUN[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-@")] = True
EMAIL = re.compile(rb"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(rb"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = np.zeros(256, bool)
DIGIT[0x30:0x3A] = True
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True
IDENT = LETTERS.copy()
IDENT[list(MARKS)] = True
#: Pieces that stand for a text's ends, and for any word with a digit.
BEGIN, END, NUMBER = U(0x1F83D9ABFB41BD6B), U(0x5BE0CD19137E2179), U(0x9B05688C2B3E6C1F)
WIDTHS = 4
BITS = 24


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i & 1:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def base_spans(buf: np.ndarray, off: np.ndarray):
    """(document, kind, start, end) of the base entities, in byte positions of the chunk."""
    raw = buf.tobytes()
    out = []
    at = np.flatnonzero(buf == 64)
    if len(at):
        no = np.flatnonzero(~EMAIL_RUN[buf])
        doc = np.searchsorted(off, at, "right") - 1
        k = np.searchsorted(no, at)
        left = np.where(k > 0, no[np.maximum(k - 1, 0)] + 1 if len(no) else 0, 0)
        right = np.where(k < len(no), no[np.minimum(k, len(no) - 1)] if len(no) else len(buf), len(buf))
        left, right = np.maximum(left, off[doc]), np.minimum(right, off[doc + 1])
        for a, b, d in sorted(set(zip(left.tolist(), right.tolist(), doc.tolist(), strict=True))):
            out += [(d, 0, a + m.start(), a + m.end()) for m in EMAIL.finditer(raw[a:b])]
    digit = np.flatnonzero(DIGIT[buf])
    if len(digit):
        doc = np.searchsorted(off, digit, "right") - 1
        gap = np.diff(digit)
        same = doc[1:] == doc[:-1]
        between = buf[np.minimum(digit[:-1] + 1, len(buf) - 1)]
        for kind, joined in ((1, (gap == 1) | ((gap == 2) & (between == 46))), (2, (gap == 1) | ((gap == 2) & ((between == 32) | (between == 45))))):
            first = np.flatnonzero(np.concatenate(([True], ~(joined & same))))
            last = np.append(first[1:], len(digit)) - 1
            n = last - first + 1
            a, b = digit[first], digit[last] + 1
            if kind == 1:
                some = np.flatnonzero((n >= 4) & (b - a >= 7) & (b - a - n >= 3))
                for i in some.tolist():
                    s = int(a[i])
                    for m in IP.finditer(raw[s : b[i]]):
                        if all(int(x) <= 255 for x in m[0].split(b".")):
                            out.append((int(doc[first[i]]), 1, s + m.start(), s + m.end()))
            else:
                for i in np.flatnonzero((n >= 12) & (n <= 19)).tolist():
                    if luhn(buf[digit[first[i] : last[i] + 1]].tobytes()):
                        out.append((int(doc[first[i]]), 2, int(a[i]), int(b[i])))
        plus = np.flatnonzero(buf == 43)
        for s, d in zip(plus.tolist(), (np.searchsorted(off, plus, "right") - 1).tolist(), strict=True):
            m = PHONE.match(raw, s, int(off[d + 1]))
            if m and 9 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
                out.append((d, 3, s, m.end()))
    out.sort(key=lambda x: (x[0], x[2], x[1]))
    return out


def secret(value: bytes) -> bool:
    """Whether an instance looks like a key or token: long, of letters and digits in turn."""
    if len(value) < 20 or not re.fullmatch(rb"[A-Za-z0-9+/_-]+", value):
        return False
    digits = [48 <= c <= 57 for c in value if c not in b"+/_-"]
    return sum(x != y for x, y in zip(digits, digits[1:], strict=False)) >= 6


def pieces(buf, off):
    """(starts, hashes, bounds of documents) of the words and marks."""
    low = core.LOWER[buf]
    starts, ends = core.spans(low, off, LETTERS)
    marks = np.flatnonzero(~LETTERS[low] & core.NONBLANK[low])
    h = core.hashes(low, starts, ends)
    digits = np.concatenate(([0], np.cumsum(DIGIT[low], dtype=np.int64)))
    h[digits[ends] > digits[starts]] = NUMBER
    every = np.concatenate((starts, marks))
    o = np.argsort(every, kind="stable")
    starts = every[o]
    return starts, np.concatenate((h, core.mix(low[marks].astype(U) + U(1))))[o], core.per_doc(off, starts)


def contexts(h, first, after, low, high) -> np.ndarray:
    """The patterns, as rows of ``WIDTHS``, of what begins at the piece ``first`` and ends before ``after``; low and high bound its document."""
    padded = np.concatenate((np.full(3, BEGIN), h, [END]))

    def before(k):
        return np.where(first - k >= low, padded[np.maximum(first - k, -3) + 3], BEGIN)

    b1, b2, b3 = before(1), before(2), before(3)
    right = np.where(after < high, padded[np.minimum(after, len(h)) + 3], END)
    two = core.mix(core.mix(b2 + U(11)) + b1)
    return np.stack((two, core.mix(core.mix(two + U(12)) + b3), core.mix(core.mix(two + U(13)) + right), core.mix(core.mix(b1 + U(14)) + right)), axis=1)


def candidates(buf, off, base, least: int):
    """(document, start, end, kind, value) and patterns of identifier-like words and base entities; kind -1: not a seed."""
    starts, ends = core.spans(buf, off, IDENT)
    c = np.concatenate(([0], np.cumsum(DIGIT[buf], dtype=np.int64)))
    some = np.flatnonzero((c[ends] > c[starts]) & (ends - starts >= least))
    raw = buf.tobytes()
    begin = np.array([a for _, _, a, _ in base], np.int64)
    reach = np.maximum.accumulate(np.array([e for _, _, _, e in base], np.int64)) if base else begin
    found = []
    for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True):
        word = raw[a:b]
        a += len(word) - len(word.lstrip(MARKS))
        word = word.strip(MARKS)
        b = a + len(word)
        if len(word) < least or c[b] == c[a]:
            continue
        k = int(np.searchsorted(begin, b)) - 1
        if k < 0 or reach[k] <= a:  # else it overlaps a base entity
            found.append((a, b, SECRET if secret(word) else -1))
    found += [(a, b, kind) for _, kind, a, b in base]
    if not found:
        return [], np.zeros((0, WIDTHS), U)
    piece, h, bounds = pieces(buf, off)
    at, to = np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64)
    doc = np.searchsorted(off, at, "right") - 1
    rows = contexts(h, np.searchsorted(piece, at), np.searchsorted(piece, to), bounds[doc], bounds[doc + 1])
    value = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little", signed=True) for a, b, _ in found]
    return [(d, a, b, kind, v) for d, (a, b, kind), v in zip(doc.tolist(), found, value, strict=True)], rows


SPANS = "array<struct<start:int,kind:int,end:int>>"
TABLE = f"doc_id long, row long, spans {SPANS}, starts array<int>, ends array<int>, kinds array<int>, vals array<long>, patterns array<array<long>>"


def row_keys(buf, off):
    """Equal documents have equal spans: the text's digest stands for the row."""
    raw = buf.tobytes()
    return pa.array([int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little", signed=True) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], pa.int64())


def scan(docs, least: int):
    """Per document its base spans, and its instances as parallel arrays."""

    def run(batches):
        for batch, buf, off in core.chunks(batches):
            base = base_spans(buf, off)
            cand, rows = candidates(buf, off, base, least)
            cp = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80, dtype=np.int64)))
            n = batch.num_rows
            spans, cols = [[] for _ in range(n)], [[[] for _ in range(n)] for _ in range(5)]
            for d, kind, a, b in base:
                o = cp[off[d]]
                spans[d].append({"start": int(cp[a] - o), "kind": kind, "end": int(cp[b] - o)})
            for (d, a, b, kind, v), p in zip(cand, rows.view(np.int64).tolist(), strict=True):
                o = cp[off[d]]
                for c, x in zip(cols, (int(cp[a] - o), int(cp[b] - o), kind, v, p), strict=True):
                    c[d].append(x)
            t = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            i4, i8 = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), row_keys(buf, off), pa.array(spans, t), *(pa.array(c, x) for c, x in zip(cols, (i4, i4, i4, i8, pa.list_(i8)), strict=True))], names=[x.split()[0] for x in TABLE.replace(SPANS, "x").split(", ")])

    return core.docs_of(docs).mapInArrow(run, TABLE)


def bitmap(patterns) -> np.ndarray:
    """Which of 2 ** BITS values the patterns' high bits take; of fixed size, whatever their number."""

    def run(batches):
        bits = np.zeros(1 << BITS, bool)
        for batch in batches:
            bits[(batch.column(0).to_numpy(zero_copy_only=False).view(U) >> U(64 - BITS)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([_zip(np.packbits(bits))], pa.binary())], names=["block"])

    out = np.zeros(1 << (BITS - 3), np.uint8)
    for (block,) in patterns.select("pattern").coalesce(16).mapInArrow(core.lean(run), "block binary").collect():  # 16 rows at most
        out |= np.frombuffer(_unzip(bytes(block))[0], np.uint8)
    return np.unpackbits(out).view(bool)


def totals(docs, patterns):
    """pattern, total: everything in the corpus that follows it (or stands in it), for all of ``patterns`` and some others."""
    from pyspark.sql import functions as F

    bits = docs.sparkSession.sparkContext.broadcast(bitmap(patterns))

    def run(batches):
        for _, buf, off in core.chunks(batches):
            _, h, bounds = pieces(buf, off)
            doc = core.word_docs(bounds, len(h))
            at = np.arange(len(h))
            every = contexts(h, at, at + 1, bounds[doc], bounds[doc + 1]).ravel()
            p, n = np.unique(every[bits.value[(every >> U(64 - BITS)).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    return core.docs_of(docs).mapInArrow(core.lean(run), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("total"))


def patterns(docs, scanned, rounds: int, support: int, precision: float):
    """(pattern, kind, score) of the patterns that qualify in the last round."""
    from pyspark.sql import functions as F

    each = scanned.select(F.explode(F.arrays_zip("patterns", "vals", "kinds")).alias("x")).select(F.explode("x.patterns").alias("pattern"), F.col("x.vals").alias("value"), F.col("x.kinds").alias("kind"))
    edges = core.save(each.groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("kind").alias("kind")))
    many = core.save(edges.groupBy("pattern").agg(F.count("*").alias("values"), F.sum("n").alias("found")).where(F.col("values") >= support))
    able = many.join(totals(docs, many), "pattern").where("2 * found >= total").select("pattern")
    # A value that is a seed anywhere is one everywhere.
    seeds = edges.where("kind >= 0").groupBy("value").agg(F.max("kind").alias("seed"))
    graph = core.save(edges.select("pattern", "value").join(able, "pattern").join(seeds, "value", "left"))
    belief, good = None, None
    for _ in range(rounds):
        p = F.when(F.col("seed").isNotNull(), 1.0)
        known = graph.withColumn("p", p.otherwise(0.0)).withColumn("as", F.col("seed"))
        if belief is not None:
            known = graph.join(belief, "value", "left").withColumn("p", p.when(F.col("best.pattern") == F.col("pattern"), F.coalesce("second", F.lit(0.0))).otherwise(F.coalesce("best.score", F.lit(0.0)))).withColumn("as", F.coalesce("seed", "best.kind"))
        sure = F.col("p") >= 0.5
        scored = known.groupBy("pattern").agg((F.round(F.sum("p"), 9) / (F.count("*") + 1)).alias("score"), F.count_if(sure).alias("sure"), F.mode(F.when(sure, F.col("as")), True).alias("kind"))
        good = core.save(scored.where((F.col("sure") >= support) & (F.col("score") >= precision)).select("score", "pattern", "kind"))
        held = graph.where("seed IS NULL").join(good, "pattern").select("value", F.struct("score", "pattern", "kind").alias("x"))
        best = held.groupBy("value").agg(F.max("x").alias("best"))
        belief = core.save(held.join(best, "value").groupBy("value").agg(F.first("best").alias("best"), F.max(F.when(F.col("x.pattern") != F.col("best.pattern"), F.col("x.score"))).alias("second")))
    return good


def found(docs, least: int, rounds: int, support: int, precision: float):
    """doc_id, row, spans and added: the base spans and the method's, per document."""
    from pyspark.sql import functions as F

    scanned = core.save(scan(docs, least))
    good = patterns(docs, scanned, rounds, support, precision)
    cand = scanned.select("doc_id", "row", F.explode(F.arrays_zip("starts", "ends", "kinds", "patterns")).alias("x")).where(f"x.kinds < 0 OR x.kinds = {SECRET}")
    cand = cand.select("doc_id", "row", F.col("x.starts").alias("start"), F.col("x.ends").alias("end"), F.explode("x.patterns").alias("pattern")).distinct()
    spans = cand.join(good, "pattern").groupBy("doc_id", "row", "start", "end").agg(F.max(F.struct("score", "kind")).alias("k")).select("doc_id", "row", "start", F.col("k.kind").alias("kind"), "end")
    added = spans.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))
    return scanned.select("doc_id", "row", "spans").alias("s").join(added.alias("a"), F.expr("s.doc_id <=> a.doc_id AND s.row = a.row"), "left").select("s.doc_id", "s.row", "s.spans", F.coalesce("a.added", F.array().cast(SPANS)).alias("added"))


def report(docs, least: int = 6, rounds: int = 3, support: int = 4, precision: float = 0.5):
    """Counts and spans of personal data per document, base and added ones."""
    from pyspark.sql import functions as F

    names = F.array(*(F.lit(k) for k in KINDS))
    text = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    every = F.array_sort(F.concat("spans", "added"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found(docs, least, rounds, support, precision).select("doc_id", *(count(k) for k in range(4)), F.sha2(text(F.col("spans")), 256).alias("base_sha256"), text(every).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(every).cast("long").alias("n_spans"))


def redact(docs, least: int = 6, rounds: int = 3, support: int = 4, precision: float = 0.5):
    """The documents, all columns, with each span replaced by its kind in brackets; overlapping spans by that of the first.

    ``n_chars``, where there is such a column, is the new text's length.
    """
    from pyspark.sql import functions as F

    names, schema = docs.columns, docs.schema
    key, doc, at = core.fresh(names, "row", "doc", "at")
    ti, ci = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def keyed(batches):
        for batch, buf, off in core.chunks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, row_keys(buf, off)], names=[*names, key])

    where = found(docs, least, rounds, support, precision).select(F.col("doc_id").alias(doc), F.col("row").alias(key), F.array_sort(F.concat("spans", "added")).alias(at)).where(F.size(at) > 0).dropDuplicates([doc, key])
    rows = docs.mapInArrow(keyed, type(schema)([*schema.fields, *type(schema)().add(key, "long").fields]))
    rows = rows.alias("l").join(where.alias("r"), (F.col(f"l.{key}") == F.col(f"r.{key}")) & F.col("doc_id").cast("long").eqNullSafe(F.col(doc)), "left").select("l.*", at).drop(key)

    def cut(batches):
        for batch in batches:
            texts, changed = batch.column(ti).to_pylist(), []
            for i, spans in enumerate(batch.column(len(names)).to_pylist()):
                changed.append(bool(spans))
                end, out = 0, []
                for x in spans or ():
                    if x["start"] >= end:
                        out += [texts[i][end : x["start"]], f"[{KINDS[x['kind']]}]"]
                    end = max(end, x["end"])
                if spans:
                    texts[i] = "".join(out) + texts[i][end:]
            cols = list(batch.columns)[: len(names)]
            cols[ti] = pa.array(texts, cols[ti].type)
            if ci is not None:
                cols[ci] = pa.compute.if_else(pa.array(changed), pa.compute.utf8_length(cols[ti]).cast(cols[ci].type), cols[ci])
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.mapInArrow(cut, schema)


QUERY = "op6_bootstrapped_pii"


def query(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
