"""Toxicity by nearest labelled examples: exact TF-IDF cosine, block-max index.

Fitting, on labelled rows only where crc32(doc_id as text) mod ``folds`` is
not ``held_out``:

1. Examples: at most ``examples`` labelled documents of at most ``example_bytes``
   bytes, those of least hashed doc_id (documented bounds of the fitted sample).
2. Terms: every word of theirs, and the beginnings of words; none is left out.
3. Document frequencies of the terms over *all* documents, by one scan.
4. A term's weight is (1 + log count) x idf x (``least`` + (1 - least) z2 / (z2 + 30)),
   where z is how many standard deviations its labels in the examples are off
   what their rate gives (one more in the variance, so that rare terms don't
   decide).  Terms that tell the labels apart thus weigh most, yet the nearest
   of a document without them are those of its topic.
5. The inverted index: postings of (example, weight) per term and block of
   examples, and for each the largest weight.  The ``DENSE`` terms with the
   longest lists are rows of a matrix instead.

Scoring, one scan without a shuffle: documents' vectors, and by one product
what the matrix' terms give each example; with the largest such sum of a block
and its lists' largest weights a block has an upper bound.  Blocks are scored
in order of their bounds, until no block left can beat the k-th best example;
the best are scored again in double precision, and equal scores go to the
earlier example.  The nearest ``k`` vote
with their cosines as weights, against the base rate as a prior, and a monotone
calibration fitted by leave-one-out on the examples (pool-adjacent-violators,
linear between its steps) turns the vote into a probability.  The index is
broadcast; the sample's two bounds bound it.

Defined cases: a null, empty or blank text has no term and gets the calibrated
rate of examples without neighbours; repeated rows are scored alike; a null
doc_id is not held out; without any usable label every score is 0; labels of
null doc_id or null value are ignored, of several labels of one doc_id the
largest counts; a text of any length is scored whole.  A doc_id must be a
number: another type is cast, and what can't be cast raises.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

from . import core

U = np.uint64
BLOCK = 64
DENSE = 1024
#: More than the rounding of a sum in single precision.
SLACK = 1e-5
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = LETTER[0x80:] = True


PREFIXES = (3, 5)


def features(buf, off):
    """(hashes, documents) of the lower-cased words and of their beginnings of 3 and 5 characters."""
    buf = core.LOWER[buf]
    starts, ends = core.spans(buf, off, LETTER)
    doc = core.word_docs(core.per_doc(off, starts), len(starts))
    lead = np.flatnonzero((buf & 0xC0) != 0x80)
    first = np.searchsorted(lead, starts)
    lead = np.append(lead, np.full(max(PREFIXES), len(buf)))
    all_s, all_e, d, salt = [starts], [ends], [doc], [np.zeros(len(starts), U)]
    for k in PREFIXES:
        e = lead[first + k]
        long = e < ends
        all_s.append(starts[long]), all_e.append(e[long]), d.append(doc[long]), salt.append(np.full(int(long.sum()), k, U))
    return core.mix(core.hashes(buf, np.concatenate(all_s), np.concatenate(all_e)) + np.concatenate(salt)), np.concatenate(d)


def counts(buf, off, vocabulary):
    """(document, term number, count) of a chunk's features in the sorted ``vocabulary``, by document and term."""
    h, doc = features(buf, off)
    if not len(h) or not len(vocabulary):
        return (np.zeros(0, np.int64),) * 3
    # A feature is looked up once a chunk, in order, however often it occurs.
    o = core.order(h)
    h, doc = h[o], doc[o]
    run = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    at = np.minimum(np.searchsorted(vocabulary, h[run]), len(vocabulary) - 1)
    known = vocabulary[at] == h[run]
    size = np.diff(np.append(run, len(h)))
    m = np.repeat(known, size)
    key = np.sort((doc[m].astype(U) << U(32)) | np.repeat(at[known], size[known]).astype(U))
    run = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(run, len(key)))
    return (key[run] >> U(32)).astype(np.int64), (key[run] & U(0xFFFFFFFF)).astype(np.int64), n


class Index:
    """Examples as unit vectors of term weights, in blocks; exact nearest neighbours by cosine."""

    def __init__(self, doc, term, weight, n_docs: int, n_terms: int, labels: np.ndarray):
        norm = np.sqrt(np.bincount(doc, weights=weight**2, minlength=n_docs))
        weight = weight / np.where(norm > 0, norm, 1)[doc]
        # Like examples lie together, by their strongest term, so that the blocks' bounds are tight.
        strongest = np.full(n_docs, n_terms)
        o = np.lexsort((-weight, doc))
        first = o[np.concatenate(([True], doc[o][1:] != doc[o][:-1]))] if len(o) else o
        strongest[doc[first]] = term[first]
        by = np.lexsort((np.arange(n_docs), strongest))
        place = np.empty(n_docs, np.int64)
        place[by] = np.arange(n_docs)
        self.original, self.labels = by, labels[by].astype(np.float64)
        doc = place[doc]
        self.n, self.n_blocks = n_docs, max(1, -(-n_docs // BLOCK))
        often = np.argsort(-np.bincount(term, minlength=n_terms), kind="stable")[:DENSE]
        self.dense_of = np.full(n_terms, -1, np.int32)
        self.dense_of[often] = np.arange(len(often))
        self.dense = np.zeros((len(often), n_docs), np.float32)
        many = self.dense_of[term] >= 0
        self.dense[self.dense_of[term[many]], doc[many]] = weight[many]
        doc, term, weight = doc[~many], term[~many], weight[~many]
        o = np.lexsort((doc, term))
        doc, term = doc[o], term[o]
        self.doc, self.weight = doc.astype(np.int32), weight[o].astype(np.float32)
        # Per term and block that has any of its postings: where these begin, and the largest weight.
        block = doc // BLOCK
        at = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])))) if len(doc) else np.zeros(0, np.int64)
        self.begin = np.append(at, len(doc)).astype(np.int32)
        self.block = block[at].astype(np.int32)
        self.most = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0, np.float32)
        self.start = np.searchsorted(term[at], np.arange(n_terms + 1)).astype(np.int32)
        self.prior = float(labels.mean()) if n_docs else 0.0

    def products(self, doc, term, weight, n_docs: int) -> np.ndarray:
        """What the matrix' terms give each example, for documents 0 to n_docs - 1."""
        at = self.dense_of[term]
        m = at >= 0
        q = np.zeros((n_docs, len(self.dense)), np.float32)
        q[doc[m], at[m]] = weight[m]
        return q @ self.dense

    def nearest(self, terms, weights, k: int, skip: int = -1, base=None):
        """(examples, cosines) of the k nearest of positive cosine; ``skip`` is left out; base: a row of ``products``, if it's there already."""
        at = self.dense_of[terms]
        many = at >= 0
        at, heavy = at[many], weights[many]
        if base is None:
            base = self.products(np.zeros(len(terms), np.int64), terms, weights, 1)[0]
        few = terms[~many]
        n = self.start[few + 1] - self.start[few]
        entry = core.ragged(self.start[few], n)
        w = np.repeat(weights[~many], n)
        block = self.block[entry]
        padded = np.zeros(self.n_blocks * BLOCK, np.float32)
        padded[: self.n] = base
        bound = padded.reshape(-1, BLOCK).max(axis=1) + np.bincount(block, weights=w * self.most[entry], minlength=self.n_blocks)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_i, best_s, best_r = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
        least, done, step = -1.0, 0, 4
        while done < len(order):
            if len(best_s) >= k:  # all blocks that may hold a better one
                step = int(np.searchsorted(-bound[order[done:]], -(least - SLACK), "right"))
                if not step:
                    break
            some = np.zeros(self.n_blocks, bool)
            some[order[done : done + step]] = True
            done, step = done + step, step * 2
            e = entry[some[block]]
            size = self.begin[e + 1] - self.begin[e]
            p = core.ragged(self.begin[e], size)
            rest = np.bincount(self.doc[p], weights=np.repeat(w[some[block]], size) * self.weight[p], minlength=self.n)
            score = base + rest
            i = np.flatnonzero((score > max(0.0, least - SLACK)) & np.repeat(some, BLOCK)[: self.n])
            i = i[i != skip]
            best_i, best_s, best_r = np.concatenate((best_i, i)), np.concatenate((best_s, score[i])), np.concatenate((best_r, rest[i]))
            if len(best_s) >= k:
                least = float(np.partition(best_s, len(best_s) - k)[len(best_s) - k])
                m = best_s >= least - SLACK
                best_i, best_s, best_r = best_i[m], best_s[m], best_r[m]
        exact = np.round(heavy @ self.dense[at[:, None], best_i].astype(np.float64) + best_r, 9)
        best_i, exact = best_i[exact > 0], exact[exact > 0]
        o = np.lexsort((self.original[best_i], -exact))[:k]
        return best_i[o], exact[o]

    def vote(self, terms, weights, k: int, skip: int = -1, base=None) -> float:
        """The neighbours' labels weighted by cosine, with the base rate as one more voice; -1 without a neighbour."""
        i, s = self.nearest(terms, weights, k, skip, base)
        if not len(i):
            return -1.0
        return float((s @ self.labels[i] + self.prior * 0.5) / (s.sum() + 0.5))


def isotonic(x: np.ndarray, y: np.ndarray):
    """(places, values) of the best non-decreasing step function, by pooling adjacent violators; a step's place is its mean."""
    o = np.argsort(x, kind="stable")
    x, y = x[o], y[o]
    ux, at, n = np.unique(x, return_index=True, return_counts=True)
    mean = np.add.reduceat(y, at) / n if len(y) else y
    stack: list[list[float]] = []
    for v, m, c in zip(ux.tolist(), mean.tolist(), n.tolist(), strict=True):
        stack.append([v, m, c])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            b, a = stack.pop(), stack.pop()
            z = a[2] + b[2]
            stack.append([(a[0] * a[2] + b[0] * b[2]) / z, (a[1] * a[2] + b[1] * b[2]) / z, z])
    return np.array([s[0] for s in stack]), np.maximum.accumulate(np.array([(s[1] * s[2] + 0.1) / (s[2] + 1) for s in stack]))


class Model:
    """Terms, their weights, the index and the calibration."""

    def __init__(self, vocabulary, weight, index, k):
        self.vocabulary, self.weight, self.index, self.k = vocabulary, weight, index, k
        self.steps = (np.zeros(0), np.zeros(0))

    def vector(self, term, n):
        w = (1 + np.log(n)) * self.weight[term]
        norm = np.sqrt((w**2).sum())
        return w / norm if norm > 0 else w

    def calibrated(self, votes: np.ndarray) -> np.ndarray:
        x, y = self.steps
        return np.interp(votes, x, y) if len(y) else np.zeros(len(votes))

    def votes(self, buf, off, skip=None) -> np.ndarray:
        doc, term, n = counts(buf, off, self.vocabulary)
        cuts = np.searchsorted(doc, np.arange(len(off))).tolist()
        w = (1 + np.log(n)) * self.weight[term]
        norm = np.sqrt(np.bincount(doc, weights=w**2, minlength=len(off) - 1))
        w /= np.where(norm > 0, norm, 1)[doc]
        out = np.full(len(off) - 1, -1.0)
        for a in range(0, len(out), 256):  # documents whose products are in memory at a time
            b = min(a + 256, len(out))
            x = slice(cuts[a], cuts[b])
            base = self.index.products(doc[x] - a, term[x], w[x], b - a)
            for d in range(a, b):
                y = slice(cuts[d], cuts[d + 1])
                if cuts[d] < cuts[d + 1]:
                    out[d] = self.index.vote(term[y], w[y], self.k, -1 if skip is None else skip[d], base[d - a])
        return np.round(out, 9)

    def scores(self, buf, off) -> np.ndarray:
        return self.calibrated(self.votes(buf, off)) if len(off) > 1 else np.zeros(0)


def held(doc_id, folds: int, part: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == part


def fit(docs, labels, label: str = "toxic", folds: int = 4, held_out: int = 2, examples: int = 4_000, example_bytes: int = 1 << 17, least: float = 0.05, k: int = 25) -> Model:
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    docs = core.docs_of(docs)
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(f"doc_id IS NOT NULL AND y IS NOT NULL AND crc32(CAST(doc_id AS STRING)) % {folds} <> {held_out}")
    usable = usable.groupBy("doc_id").agg(F.max("y").alias("y"))
    # Of rows that repeat a doc_id, the least text is the example.
    rows = docs.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= example_bytes).join(usable, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    chosen = core.save(rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(examples), spark)
    number = {r.doc_id: i for i, r in enumerate(chosen.select("doc_id").orderBy("doc_id").collect())}
    none = np.zeros(0, np.int64)
    if not number:
        return Model(none.view(U), np.zeros(0), Index(none, none, np.zeros(0), 0, 0, np.zeros(0)), k)
    ex = chosen.repartition(min(len(number), 2 * spark.sparkContext.defaultParallelism), "doc_id")

    def present(batches):
        for batch, buf, off in core.chunks(batches):
            h, doc = features(buf, off)
            o = core.distinct_in(doc, h)
            h, doc = h[o], doc[o]
            y = np.array(batch.column(2).to_pylist(), np.int64)
            o, run = core.groups(h)
            df = np.diff(np.append(run, len(h)))
            bad = np.add.reduceat(y[doc[o]], run) if len(run) else run
            yield pa.RecordBatch.from_arrays([pa.array(h[o[run]].view(np.int64)), pa.array(df.astype(np.int64)), pa.array(bad.astype(np.int64))], names=["h", "df", "bad"])

    by_term = ex.mapInArrow(core.lean(present), "h long, df long, bad long").groupBy("h").agg(F.sum("df").alias("df"), F.sum("bad").alias("bad")).toArrow()
    h, df, bad = (by_term.column(c).to_numpy() for c in ("h", "df", "bad"))
    o = np.argsort(h.view(U))
    vocabulary, df, bad = h.view(U)[o], df[o].astype(np.float64), bad[o].astype(np.float64)
    cast = spark.sparkContext.broadcast(vocabulary)

    # Document frequencies over the whole corpus.
    def frequencies(batches):
        total, docs_ = np.zeros(len(cast.value), np.int64), 0
        for batch, buf, off in core.chunks(batches):
            _, term, _ = counts(buf, off, cast.value)
            total += np.bincount(term, minlength=len(total))
            docs_ += batch.num_rows
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(total[some], docs_))], names=["term", "n"])

    freq = docs.mapInArrow(core.lean(frequencies), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    term, n = (freq.column(c).to_numpy() for c in ("term", "n"))
    total = np.zeros(len(vocabulary) + 1)
    total[term] = n  # the number of documents is the last
    idf = np.log((total[-1] + 1) / (total[:-1] + 1)) + 1

    def vectors(batches):
        for batch, buf, off in core.chunks(batches):
            doc, term, n = counts(buf, off, cast.value)
            at = np.searchsorted(doc, np.arange(len(off))).tolist()
            cut = lambda x: [x[a:b].astype(np.int32).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(cut(term), pa.binary()), pa.array(cut(n), pa.binary())], names=["doc_id", "y", "t", "n"])

    got = ex.mapInArrow(core.lean(vectors), "doc_id long, y int, t binary, n binary").toArrow().sort_by("doc_id")
    cast.destroy()
    y = got.column("y").to_numpy().astype(np.int64)
    each = [np.frombuffer(b, np.int32) for b in got.column("t").to_pylist()]
    doc, term = np.repeat(np.arange(len(y)), [len(x) for x in each]), np.concatenate(each).astype(np.int64)
    count = np.concatenate([np.frombuffer(b, np.int32) for b in got.column("n").to_pylist()]).astype(np.float64)
    rate = y.mean()
    z2 = (bad - df * rate) ** 2 / (df * rate * (1 - rate) + 1)
    weight = idf * (least + (1 - least) * z2 / (z2 + 30))
    index = Index(doc, term, (1 + np.log(count)) * weight[term], len(y), len(vocabulary), y)
    model = Model(vocabulary, weight, index, k)
    # Calibration: every example by the others.
    place = np.empty(len(y), np.int64)
    place[index.original] = np.arange(len(y))
    cast = spark.sparkContext.broadcast((model, {i: int(place[p]) for i, p in number.items()}))

    def voted(batches):
        for batch, buf, off in core.chunks(batches):
            m, at = cast.value
            yield pa.RecordBatch.from_arrays([pa.array(m.votes(buf, off, [at[i] for i in batch.column(0).to_pylist()])), batch.column(2)], names=["v", "y"])

    votes = ex.mapInArrow(core.lean(voted), "v double, y int").toArrow()
    cast.destroy()
    model.steps = isotonic(votes.column("v").to_numpy(), votes.column("y").to_numpy().astype(np.float64))
    return model


def report(docs, model: Model, folds: int = 4, held_out: int = 2, threshold: float = 0.3):
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = cast.value
        for batch, buf, off in core.chunks(batches):
            s = m.scores(buf, off)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([held(i, folds, held_out) for i in batch.column(0).to_pylist()]), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return core.docs_of(docs).mapInArrow(run, SCHEMA)


def evidence(docs, model: Model):
    """doc_id, score, and its nearest examples as (order of doc_id among the examples, label, cosine)."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = cast.value
        for batch, buf, off in core.chunks(batches):
            doc, term, n = counts(buf, off, m.vocabulary)
            cuts = np.searchsorted(doc, np.arange(len(off)))
            near = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                i, s = m.index.nearest(term[a:b], m.vector(term[a:b], n[a:b]), m.k) if b > a else ((), ())
                near.append([{"example": int(m.index.original[x]), "label": int(m.index.labels[x]), "cosine": float(c)} for x, c in zip(i, s, strict=True)])
            t = pa.list_(pa.struct([("example", pa.int32()), ("label", pa.int32()), ("cosine", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(m.scores(buf, off)), pa.array(near, t)], names=["doc_id", "score", "evidence"])

    return core.docs_of(docs).mapInArrow(run, "doc_id long, score double, evidence array<struct<example:int,label:int,cosine:double>>")


def clean(docs, model: Model, threshold: float = 0.3):
    """The documents, all columns, that score below the threshold."""
    cast = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch, buf, off in core.chunks(batches):
            yield batch.filter(pa.array(cast.value.scores(buf, off) < threshold))

    return docs.mapInArrow(run, docs.schema)


QUERY = "op10_toxicity_neighbours"


def query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return report(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
