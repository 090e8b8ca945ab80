"""Quality rules: how well a public tokenizer fits a text, by language.

Base rules count words, symbols, repeated lines and repeated 3-word windows of
the whole text.  The method's measures come from a public vocabulary with byte
fallback: characters per token, the share of byte-fallback tokens, and the
normalised entropy of the document's tokens.  For each band group (the
document's language, or where that is null its dominant script) quartiles of
each measure are taken over *all* documents that pass the base rules, from an
exact histogram; a document is rejected outside
[q1 - low * spread, q3 + width * spread], spread = max(q3 - q1, a floor).  Junk
(symbols, tables, repetition) takes more tokens for its characters and has
fewer different ones, so ``low`` is narrow for these two; elsewhere it's width.

One scan measures every text and writes a narrow table to the shared folder;
the histogram is a partial aggregation of that table with a bounded number of
buckets per group, and the bands join it back.  Words are encoded once per
task and memory, and a document's tokens are gathered by vector operations.

Defined cases: a null, empty or blank text has no words, fails the base rules
and isn't kept; no measure is taken of a text without tokens; repeated rows
and repeated or null doc_ids each get their own result row; a group whose
documents all fail the base rules has no band and rejects by those alone.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa

from . import core

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
LINE = np.ones(256, bool)
LINE[10] = False
#: Measures are held as whole buckets of this width, which makes quartiles exact and repeatable.
STEP = {"chars_per_token": 0.01, "byte_share": 0.001, "entropy": 0.001}
#: The least spread of a band, in the measure's own unit.
FLOOR = {"chars_per_token": 0.05, "byte_share": 0.02, "entropy": 0.05}
#: The lower sides that are narrower than ``width``.
LOW = {"chars_per_token": 1.5, "entropy": 1.5}
SCRIPTS = ("Latin", "Cyrillic", "Arabic", "Han", "Other")
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, band string, chars_per_token int, byte_share int, entropy int"


def _sum(off: np.ndarray, flags: np.ndarray) -> np.ndarray:
    c = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
    return c[off[1:]] - c[off[:-1]]


def dup_lines(buf, off, has_word) -> np.ndarray:
    """Per document: lines with a word that equal an earlier line."""
    starts, ends = core.spans(buf, off, LINE)  # empty lines have no word
    if not len(starts):
        return np.zeros(len(off) - 1, np.int64)
    c = np.concatenate(([0], np.cumsum(has_word, dtype=np.int64)))
    keep = c[ends] > c[starts]
    starts, ends = starts[keep], ends[keep]
    bounds = core.per_doc(off, starts)
    doc = core.word_docs(bounds, len(starts))
    h = core.mix(core.hashes(buf, starts, ends) + core.mix(doc.astype(np.uint64)))
    idx, run = core.groups(h)
    first = np.zeros(len(h), bool)
    first[idx[run]] = True
    return _sum(bounds, ~first)


def repeat_words(h, bounds) -> np.ndarray:
    """Per document: words inside 3-word windows found at least twice in it."""
    n = len(h)
    w = core.windows(h, 3)
    if not len(w):
        return np.zeros(len(bounds) - 1, np.int64)
    doc = core.word_docs(bounds, n)
    whole = doc[:-2] == doc[2:]
    at = np.flatnonzero(whole)
    flags = np.zeros(len(w), np.int32)
    flags[at] = core.repeated(core.mix(w[at] + core.mix(doc[at].astype(np.uint64))))
    return _sum(bounds, core.covered(flags, 3, n))


def script(buf, off) -> np.ndarray:
    """The dominant script of each text, from its lead bytes."""
    counts = [_sum(off, m) for m in (((buf | 32) >= 97) & ((buf | 32) <= 122) | (buf >= 0xC3) & (buf <= 0xC9), (buf >= 0xD0) & (buf <= 0xD3), (buf >= 0xD8) & (buf <= 0xDB), (buf >= 0xE3) & (buf <= 0xE9))]
    best = np.argmax(np.stack(counts), axis=0)
    best[np.stack(counts).max(axis=0) == 0] = 4
    return best


class Fertility:
    """Token ids of words by a sentencepiece model with byte fallback; a bounded memory of words."""

    def __init__(self, model: str, remember: int = 200_000):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.bytes = np.array([self.sp.is_byte(i) for i in range(self.sp.vocab_size())])
        self.known: dict[int, np.ndarray] = {}
        self.remember = remember

    def tokens(self, buf, starts, ends, h):
        """(tokens per word, all tokens in order) of the words."""
        idx, run = core.groups(h)
        number = np.empty(len(h), np.int64)
        number[idx] = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(h))))
        first = idx[run]
        if len(self.known) > self.remember:
            self.known.clear()
        keys = h[first].tolist()
        get = self.known.get
        coded = [get(k) for k in keys]
        new = [i for i, x in enumerate(coded) if x is None]
        if new:
            raw = buf.tobytes()
            at = first[new]
            for i, ids in zip(new, self.sp.encode([raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], num_threads=1), strict=True):
                coded[i] = self.known[keys[i]] = np.array(ids, np.uint16)
        size = np.array([len(x) for x in coded], np.int64)
        flat = np.concatenate(coded) if coded else np.zeros(0, np.uint16)
        start = np.cumsum(size) - size
        n = size[number]
        return n, flat[core.ragged(start[number], n)]

    def measure(self, buf, off, starts, ends, h, bounds, word_chars):
        """Buckets of the three measures per document; a text without tokens has -1."""
        n, flat = self.tokens(buf, starts, ends, h)
        upto = np.concatenate(([0], np.cumsum(n)))
        at = upto[bounds]
        count = np.diff(at)
        fallback = _sum(at, self.bytes[flat])
        doc = np.repeat(np.arange(len(count), dtype=np.uint64), count)
        s = np.sort((doc << np.uint64(16)) | flat.astype(np.uint64))
        run = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1]))) if len(s) else np.zeros(0, np.int64)
        c = np.diff(np.append(run, len(s))).astype(np.float64)
        owner = (s[run] >> np.uint64(16)).astype(np.int64)
        clogc = np.bincount(owner, weights=c * np.log2(c), minlength=len(count))
        some = np.maximum(count, 1).astype(np.float64)
        entropy = np.log2(some) - clogc / some
        entropy /= np.log2(np.clip(some, 2, self.sp.vocab_size()))
        out = {"chars_per_token": word_chars / some, "byte_share": fallback / some, "entropy": entropy}
        return {k: np.where(count > 0, np.floor(np.round(v, 6) / STEP[k] + 1e-6), -1).astype(np.int32) for k, v in out.items()}


def measures(docs, model: str):
    """Per document the base counts, the band group and the buckets of its measures."""
    has_lang = "lang" in docs.columns
    from pyspark.sql import functions as F

    slim = core.docs_of(docs).withColumn("lang", F.lit(None).cast("string")) if not has_lang else core.docs_of(docs, "doc_id", "text", "lang")

    def run(batches):
        f = Fertility(model)
        for batch, buf, off in core.chunks(batches):
            starts, ends = core.spans(buf, off, core.NONBLANK)
            bounds = core.per_doc(off, starts)
            h = core.hashes(buf, starts, ends)
            n_words = np.diff(bounds).astype(np.int64)
            chars = _sum(off, (buf & 0xC0) != 0x80) - _sum(off, core.SPACE[buf])
            repeats = repeat_words(h, bounds)
            m = f.measure(buf, off, starts, ends, h, bounds, chars)
            sc = script(buf, off)
            band = ["lang:" + x if x is not None else "script:" + SCRIPTS[s] for x, s in zip(batch.column(2).to_pylist(), sc.tolist(), strict=True)]
            cols = [batch.column(0), n_words, chars, _sum(off, SYMBOLS[buf]), dup_lines(buf, off, core.NONBLANK[buf]), repeats, (n_words < 50) | (100 * repeats > 50 * n_words), pa.array(band, pa.string()), m["chars_per_token"], m["byte_share"], m["entropy"]]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=[x.split()[0] for x in MEASURES.split(", ")])

    return slim.mapInArrow(run, MEASURES)


def bands(measured, width: float, low: dict[str, float]):
    """band, measure -> lowest and highest accepted bucket, over all documents that pass the base rules."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    each = F.explode(F.array(*(F.struct(F.lit(k).alias("measure"), F.col(k).alias("bucket")) for k in STEP)))
    hist = measured.where("NOT base_failed").select("band", each.alias("x")).select("band", "x.*").where("bucket >= 0").groupBy("band", "measure", "bucket").count()
    w = Window.partitionBy("band", "measure")
    upto = hist.withColumn("upto", F.sum("count").over(w.orderBy("bucket"))).withColumn("all", F.sum("count").over(w))
    q = upto.groupBy("band", "measure").agg(*(F.min(F.when(F.col("upto") * 4 >= F.col("all") * k, F.col("bucket"))).alias(f"q{k}") for k in (1, 3)))
    floor = F.create_map(*(F.lit(x) for k in STEP for x in (k, math.ceil(FLOOR[k] / STEP[k]))))
    below = F.create_map(*(F.lit(x) for k in STEP for x in (k, float(low.get(k, width)))))
    spread = F.greatest(F.col("q3") - F.col("q1"), floor[F.col("measure")])
    return q.select("band", "measure", (F.col("q1") - spread * below[F.col("measure")]).alias("low"), (F.col("q3") + spread * F.lit(width)).alias("high"))


def report(docs, model: str, width: float = 6.0, low: dict[str, float] = LOW):
    """One row per document: base counts, measures, and whether it is kept; ``low`` are the lower sides that aren't ``width`` wide."""
    from pyspark.sql import functions as F

    measured = core.save(measures(docs, model))
    b = bands(measured, width, low)
    wide = b.groupBy("band").agg(*(F.max(F.when(F.col("measure") == k, F.col(x))).alias(f"{k}_{x}") for k in STEP for x in ("low", "high")))
    inside = F.lit(True)
    for k in STEP:
        inside = inside & F.coalesce((F.col(k) < 0) | F.col(k).between(F.col(f"{k}_low"), F.col(f"{k}_high")), F.lit(True))
    return measured.join(wide, "band", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "band",
        *(F.when(F.col(k) >= 0, F.col(k) * F.lit(s)).alias(k) for k, s in STEP.items()),
    )


QUERY = "op4_tokenizer_fertility"


def query(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), core.tokenizer_path("piece_bpe_32k.model"))
