"""Benchmark decontamination: a broadcast hash set of normalised test n-grams.

Every document is scanned once, in vector operations over its UTF-8 bytes: the
hash of each window of ``n`` words is looked up in the benchmark's window
hashes, each hit is verified word for word, and verified spans mark words.

The plan has one stage and no shuffle.  The window index is built in blocks of
at most ``block_windows`` windows.  One block is broadcast; more are written to
the shared folder and each scan task reads them in turn, so that no more than
one block is ever in memory, whatever the benchmark's size.

Defined cases: a null or empty text has no words and no hits; a document of
fewer than n words can only be hit by items of fewer than n words; an item
without words has no window; benchmark rows with the same item_id form one
item; a null item_id is written as the empty string; repeated rows each get
their own result row; an empty benchmark hits nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from . import core

SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
BLOCK_WINDOWS = 1 << 19
#: Bytes of windows in a block; with their number it bounds what is broadcast.
BLOCK_BYTES = 128 << 20
#: Chunks of texts that are in memory while the blocks of a larger benchmark are read one after another.
HELD = 16


def item_windows(batches, n: int):
    """(length, hash, window bytes, item_id as text) for the windows of benchmark items."""
    for batch, buf, off in core.chunks(batches):
        buf = core.LOWER[buf]
        starts, ends = core.spans(buf, off, core.ALNUM)
        h = core.hashes(buf, starts, ends)
        bounds = core.per_doc(off, starts)
        raw, ids = buf.tobytes(), batch.column(0).to_pylist()
        k_, h_, w_, i_ = [], [], [], []
        for d in range(batch.num_rows):
            a, b = int(bounds[d]), int(bounds[d + 1])
            k = min(n, b - a)
            if not k:
                continue
            words = [raw[s:e] for s, e in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True)]
            wh = core.windows(h[a:b], k).view(np.int64).tolist()
            for j, x in enumerate(wh):
                k_.append(k), h_.append(x), w_.append(b" ".join(words[j : j + k])), i_.append("" if ids[d] is None else str(ids[d]))
        yield pa.RecordBatch.from_arrays([pa.array(k_, pa.int32()), pa.array(h_, pa.int64()), pa.array(w_, pa.binary()), pa.array(i_, pa.string())], names=["k", "h", "w", "item"])


class Block:
    """The windows of one index block: per length the sorted hashes, and what they stand for."""

    def __init__(self, rows):
        self.of: dict[tuple[int, int], dict[bytes, list[str]]] = {}
        for k, h, w, items in rows:
            self.of.setdefault((k, h), {})[bytes(w)] = list(items)
        self.sorted = {}
        for k in {k for k, _ in self.of}:
            self.sorted[k] = np.sort(np.array([h for q, h in self.of if q == k], np.int64).view(np.uint64))


def build(spark, benchmark, n: int, block_windows: int):
    """Blocks of the window index: ("memory", broadcast) or ("files", paths)."""
    from pyspark.sql import functions as F

    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    w = items.mapInArrow(lambda it: item_windows(it, n), "k int, h long, w binary, item string").groupBy("k", "h", "w").agg(F.array_sort(F.collect_set("item")).alias("items"))
    w = core.save(w, spark)
    total, size = w.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("w")), F.lit(0))).first()
    n_blocks = max(1, -(-total // block_windows), -(-size // BLOCK_BYTES))
    if n_blocks == 1:
        return "memory", spark.sparkContext.broadcast(Block([tuple(r) for r in w.collect()]))
    path = core.shared_dir(spark)
    w.withColumn("block", F.pmod(F.col("h"), F.lit(n_blocks))).write.partitionBy("block").parquet(path)
    return "files", [f"{path}/block={i}" for i in range(n_blocks)]


def _load(kind, what):
    if kind == "memory":
        yield what.value
        return
    import pyarrow.fs as pf
    import pyarrow.parquet as pq

    for path in what:
        fs, p = pf.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pf.LocalFileSystem(), path)
        if fs.get_file_info(p).type == pf.FileType.NotFound:
            continue
        t = pq.read_table(p, filesystem=fs)
        yield Block(zip(t["k"].to_pylist(), t["h"].to_pylist(), t["w"].to_pylist(), t["items"].to_pylist(), strict=True))


class Chunk:
    """The words of one chunk, which of them are hit, and the items found by document."""

    def __init__(self, batch, buf, off):
        self.batch, self.raw, self.off = batch, buf, off
        self.buf = core.LOWER[buf]
        self.starts, self.ends = core.spans(self.buf, off, core.ALNUM)
        self.bounds = core.per_doc(off, self.starts)
        self.h = core.hashes(self.buf, self.starts, self.ends)
        self.owner = core.word_docs(self.bounds, len(self.starts))
        self.edges = np.zeros(len(self.starts) + 1, np.int32)
        self.items: dict[int, set] = {}

    def match(self, block: Block):
        for k, known in block.sorted.items():
            wh = core.windows(self.h, k)
            at = np.flatnonzero(core.member(wh, known))
            at = at[self.owner[at] == self.owner[at + k - 1]] if len(at) else at
            for j, x in zip(at.tolist(), wh[at].view(np.int64).tolist(), strict=True):
                words = b" ".join([self.buf[s:e].tobytes() for s, e in zip(self.starts[j : j + k], self.ends[j : j + k], strict=True)])
                found = block.of[k, x].get(words)
                if found is not None:
                    self.edges[j] += 1
                    self.edges[j + k] -= 1
                    self.items.setdefault(int(self.owner[j]), set()).update(found)

    @property
    def hit(self):
        return np.cumsum(self.edges)[:-1] > 0


def scanned(batches, kind, what):
    """The chunks of a task, matched with every block; each block is read once for up to ``HELD`` chunks."""
    held: list[Chunk] = []

    def matched():
        for block in _load(kind, what):
            for c in held:
                c.match(block)
        yield from held
        held.clear()

    for batch, buf, off in core.chunks(batches):
        held.append(Chunk(batch, buf, off))
        if len(held) >= (1 if kind == "memory" else HELD):
            yield from matched()
    yield from matched()


def report(docs, benchmark, n: int = 8, min_items: int = 2, block_windows: int = BLOCK_WINDOWS):
    """One row per document: words, hit words, items found, verdict."""
    spark = docs.sparkSession
    kind, what = build(spark, benchmark, n, block_windows)

    def run(batches):
        for x in scanned(batches, kind, what):
            batch, bounds, hit, items = x.batch, x.bounds, x.hit, x.items
            c = np.concatenate(([0], np.cumsum(hit)))
            found = [sorted(items.get(d, ())) for d in range(batch.num_rows)]
            count = np.array([len(x) for x in found], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array((c[bounds[1:]] - c[bounds[:-1]]).astype(np.int64)),
                    pa.array(count),
                    pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in found], pa.string()),
                    pa.array(count >= min_items),
                ],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return core.docs_of(docs).mapInArrow(run, SCHEMA)


def clean(docs, benchmark, n: int = 8, min_items: int = 2, mode: str = "documents", block_windows: int = BLOCK_WINDOWS):
    """The documents without contamination; all columns of ``docs`` stay.

    mode "documents" drops a document in which windows of at least
    ``min_items`` items occur; "spans" keeps every document and cuts the hit
    words, with the bytes between them, out of its text; "both" drops as
    "documents" does, cuts the hit words out of the rest, and drops those that
    had words and have none left.  ``n_chars``, where there is such a column,
    is the new text's length.
    """
    if mode not in ("documents", "spans", "both"):
        raise ValueError(f"mode is documents, spans or both, not {mode!r}")
    spark = docs.sparkSession
    kind, what = build(spark, benchmark, n, block_windows)
    ti = docs.columns.index("text")
    ci = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for x in scanned(batches, kind, what):
            batch, buf, off, starts, ends, bounds, hit, items = x.batch, x.raw, x.off, x.starts, x.ends, x.bounds, x.hit, x.items
            if mode == "documents":
                yield batch.filter(pa.array([len(items.get(d, ())) < min_items for d in range(batch.num_rows)]))
                continue

            cut = np.zeros(len(buf) + 1, np.int32)
            at = np.flatnonzero(hit)
            if len(at):
                owner = core.word_docs(bounds, len(starts))
                last = np.ones(len(at), bool)
                last[:-1] = (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])
                first = np.concatenate(([True], last[:-1]))
                np.add.at(cut, starts[at[first]], 1)
                np.add.at(cut, ends[at[last]], -1)
            keep = np.cumsum(cut)[:-1] == 0
            c = np.concatenate(([0], np.cumsum(keep)))
            text = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(c[off].astype(np.int64)), pa.py_buffer(buf[keep].tobytes())])
            old = batch.column(ti)
            text = pa.compute.if_else(old.is_null(), pa.scalar(None, pa.large_string()), text) if old.null_count else text
            cols = list(batch.columns)
            cols[ti] = text.cast(old.type)
            c = np.concatenate(([0], np.cumsum(hit)))
            n_hit = c[bounds[1:]] - c[bounds[:-1]]
            if ci is not None:
                cols[ci] = pa.compute.if_else(pa.array(n_hit > 0), pa.compute.utf8_length(text).cast(cols[ci].type), cols[ci])
            out = pa.RecordBatch.from_arrays(cols, schema=batch.schema)
            if mode == "both":
                out = out.filter(pa.array([len(items.get(d, ())) < min_items and (not k or k < w) for d, (k, w) in enumerate(zip(n_hit.tolist(), np.diff(bounds).tolist(), strict=True))], pa.bool_()))
            yield out

    return docs.mapInArrow(run, docs.schema)


QUERY = "op2_decontamination"


def query(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"""regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(8, len(w)) AS k, array_to_string(w[i : i + least(8, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - least(8, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
),
m AS (SELECT DISTINCT r, dw.k, i, item FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
