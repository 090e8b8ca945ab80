"""Substring dedup: compressed FM-indexes over shards of the corpus.

A window is ``length`` consecutive words; a word goes when a window that
covers it also starts anywhere else in the corpus.

* Equal windows must meet in one shard.  Each window is assigned to its
  minimizer, the least-hashed run of ``anchor`` words in it, so equal windows
  have equal minimizers.  Successive windows with one minimizer form a
  *segment*; its windows are searched only among segments of that minimizer.
* Per minimizer, segments are first aggregated by content (in each pack of
  documents, then by a shuffle of hashes): a segment whose content occurs
  twice is settled without a search and is indexed once, however many copies
  there are; a segment whose minimizer occurs nowhere else is settled too.
* The rest is sent to its shard, which builds one FM-index (Burrows-Wheeler
  transform in a wavelet matrix) and streams the segments through it: backward
  search gives the matching statistics, cut off at ``length``, and reports the
  windows found more than once.
* A minimizer with more than ``hot`` different segments is split: each of its
  windows then forms a segment of its own, sharded by the window's hash.

Documents stay in packs of bounded text, which move once; segments and
answers travel as compressed blocks keyed by pack and shard.

Defined cases: a null, empty or blank text has no words; a text of fewer than
``length`` words has no window and loses nothing; repeated rows are documents
of their own, so all their windows repeat; null and repeated doc_ids each get
their own result row; words compare by 64-bit hashes of their bytes.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa

from . import core
from .bpe import _planes, _unplanes, _unzip, _zip

PACK = 16 << 20
U = np.uint64
UNIQUE, REPEATED, QUERY_, OWNER, HOT_ = 0, 1, 2, 3, 4


class Segments:
    """The segments of a chunk of documents: numbered, in order, from its bytes alone."""

    def __init__(self, buf, off, length: int, anchor: int):
        self.buf = buf
        self.starts, self.ends = core.spans(buf, off, core.NONBLANK)
        self.bounds = core.per_doc(off, self.starts)
        h = self.h = core.hashes(buf, self.starts, self.ends)
        n, self.length = len(h), length
        count = np.maximum(np.diff(self.bounds) - length + 1, 0)
        self.window = core.ragged(self.bounds[:-1], count)  # starts of all windows, as word numbers
        empty = np.zeros(0, np.int64)
        self.first, self.n, self.key, self.content = empty, empty, np.zeros(0, U), np.zeros(0, U)
        if not len(self.window):
            return
        g = core.windows(h, anchor)
        bits = U(max(1, n.bit_length()))
        low = (U(1) << bits) - U(1)
        m = (g & ~low) | np.arange(len(g), dtype=U)
        span, have = length - anchor + 1, 1  # the least of ``span`` neighbours, by doubling
        while have * 2 <= span:
            m = np.minimum(m[:-have], m[have:])
            have *= 2
        if have < span:
            m = np.minimum(m[: len(m) - (span - have)], m[span - have :])
        at = (m[self.window] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.first = self.window[new]
        self.n = np.diff(np.append(new, len(at)))
        self.key = g[at[new]]
        p, inv = core._powers(n + 1)
        c = np.zeros(n + 1, U)
        np.cumsum(h * p[:n], out=c[1:])
        end = self.first + self.n + length - 1
        self.content = core.mix((c[end] - c[self.first]) * inv[self.first] + self.n.astype(U))


def _body(ids, texts) -> bytes:
    size = np.array([len(t) for t in texts], np.uint32)
    return _zip(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is None for i in ids]), _planes(size), b"".join(texts))


def _bodies(blocks):
    """(ids, null flags, text bytes, offsets) of the packs' documents, chunk after chunk."""
    for block in blocks:
        ids, null, size, raw = _unzip(block)
        ids, null, size = np.frombuffer(ids, np.int64), np.frombuffer(null, bool), _unplanes(size).astype(np.int64)
        buf, off = np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum(size)))
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(off, off[a] + core.CHUNK, "right")) - 1)
            yield ids[a:b], null[a:b], buf[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def _all_segments(blocks, length, anchor):
    return [Segments(buf, off, length, anchor) for _, _, buf, off in _bodies(blocks)]


def packs(parts: int, length: int, anchor: int, limit: int = PACK):
    """(pack, part, block) rows: part -1 has the documents, others the hashes of their segments."""

    def rows(ids, texts):
        body = _body(ids, texts)
        segs = _all_segments([body], length, anchor)
        key, content = np.concatenate([s.key for s in segs]), np.concatenate([s.content for s in segs])
        part = (key % U(parts)).astype(np.int64)
        name = hashlib.blake2b(body, digest_size=16).digest()
        out = [(-1, body)]
        for p, w in core.by_part(part):
            u, _, n = _distinct(key[w], content[w])
            out.append((p, _zip(u[0], u[1], np.minimum(n, 2).astype(np.uint8))))
        return pa.RecordBatch.from_arrays([pa.array([name] * len(out), pa.binary()), pa.array([p for p, _ in out], pa.int32()), pa.array([r for _, r in out], pa.binary())], names=["pack", "part", "block"])

    def run(batches):
        ids, texts, used = [], [], 0
        for batch, buf, off in core.chunks(batches):
            raw = buf.tobytes()
            for i, a, b in zip(batch.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                ids.append(i)
                texts.append(raw[a:b])
                used += b - a
                if used > limit or len(ids) >= 65536:
                    yield rows(ids, texts)
                    ids, texts, used = [], [], 0
        if ids:
            yield rows(ids, texts)

    return run


def _distinct(key, content):
    """((keys, contents) without repeats, number of each entry's pair, counts), in order of the pairs' mixed hash."""
    both = core.mix(key ^ core.mix(content))
    idx, run = core.groups(both)
    number = np.empty(len(both), np.int64)
    size = np.diff(np.append(run, len(both)))
    number[idx] = np.repeat(np.arange(len(run)), size)
    return (key[idx[run]], content[idx[run]]), number, size


def settle(hot: int):
    """What becomes of each segment content of a part: per pack, in the pack's order, a status."""

    def each(table: pa.Table) -> pa.Table:
        packs_, key, content, count, size = [], [], [], [], []
        for pack, block in zip(table.column("pack").to_pylist(), table.column("block").to_pylist(), strict=True):
            k, c, n = _unzip(block)
            packs_.append(pack), key.append(np.frombuffer(k, U)), content.append(np.frombuffer(c, U)), count.append(np.frombuffer(n, np.uint8)), size.append(len(n))
        key, content, count = np.concatenate(key), np.concatenate(content), np.concatenate(count)
        (k, _), number, _ = _distinct(key, content)
        total = np.bincount(number, weights=count)
        idx, run = core.groups(k)
        variants = np.empty(len(k), np.int64)
        each_ = np.diff(np.append(run, len(k)))
        variants[idx] = np.repeat(each_, each_)
        first = np.zeros(len(key), bool)
        seen, at = np.unique(number, return_index=True)
        first[at] = True
        one, alone = (total < 2)[number], (variants < 2)[number]
        status = np.where(alone, np.where(one, UNIQUE, REPEATED), np.where(one, QUERY_, np.where(first, OWNER, REPEATED)))
        status = (status + np.where((variants > hot)[number] & (status >= QUERY_), HOT_, 0)).astype(np.uint8)
        at = np.concatenate(([0], np.cumsum(size)))
        part = table.column("part")[0].as_py()
        return pa.table([pa.array(packs_, pa.binary()), pa.array([part] * len(packs_), pa.int32()), pa.array([_zip(status[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["pack", "part", "block"])

    return each


def _statuses(segs, replies: pa.Table, parts: int) -> np.ndarray:
    """The status of every segment of a pack."""
    key, content = np.concatenate([s.key for s in segs]), np.concatenate([s.content for s in segs])
    part = (key % U(parts)).astype(np.int64)
    by = np.argsort(part, kind="stable")
    status = np.full(len(key), 255, np.uint8)
    cuts = np.searchsorted(part[by], np.arange(parts + 1))
    for p, block in zip(replies.column("part").to_pylist(), replies.column("block").to_pylist(), strict=True):
        w = by[cuts[p] : cuts[p + 1]]
        _, number, _ = _distinct(key[w], content[w])
        answer = np.frombuffer(_unzip(block)[0], np.uint8)
        if len(answer) != int(number.max()) + 1:
            break
        status[w] = answer[number]
    if (status == 255).any():
        raise RuntimeError("the segments of a pack changed while they were counted; its input isn't repeatable")
    return status


def _join(segs, first, size, chunk) -> bytes:
    """The words of segments, in one run of bytes, each word followed by a blank."""
    out = []
    for s, seg in enumerate(segs):
        mine = chunk == s
        w = core.ragged(first[mine], size[mine])
        n = seg.ends[w] - seg.starts[w]
        src = core.ragged(seg.starts[w], n + 1)
        raw = seg.buf[np.minimum(src, len(seg.buf) - 1)]
        raw[np.cumsum(n + 1) - 1] = 32
        out.append(raw.tobytes())
    return b"".join(out)


def _plan(segs, status, length, shards):
    """(number, shard, chunk, first word, windows, is query) of what is sent: the first segment of each content, hot ones by windows."""
    chunk = np.repeat(np.arange(len(segs)), [len(s.key) for s in segs])
    key, content = np.concatenate([s.key for s in segs]), np.concatenate([s.content for s in segs])
    first, n = np.concatenate([s.first for s in segs]), np.concatenate([s.n for s in segs])
    kind, hot = status & 3, status >= HOT_
    send = np.flatnonzero(kind >= QUERY_)
    # An owner's copies in its own pack share one status; only the first is sent.
    pair = core.mix(key[send] ^ core.mix(content[send]))
    _, once = np.unique(pair, return_index=True)
    send = send[np.sort(once)]
    cold, warm = send[~hot[send]], send[hot[send]]
    out = [(cold, key[cold], chunk[cold], first[cold], n[cold], kind[cold] == QUERY_)]
    if len(warm):
        rep = np.repeat(warm, n[warm])
        w = core.ragged(first[warm], n[warm])
        wkey = np.zeros(len(w), U)
        for c in range(len(segs)):
            mine = chunk[rep] == c
            if mine.any():
                wkey[mine] = core.windows(segs[c].h, length)[w[mine]]
        out.append((rep, wkey, chunk[rep], w, np.ones(len(w), np.int64), kind[rep] == QUERY_))
    number, key, chunk, first, n, query = (np.concatenate(x) for x in zip(*out, strict=True))
    return number, (core.mix(key) % U(shards)).astype(np.int64), chunk, first, n, query


def ship(parts: int, shards: int, length: int, anchor: int):
    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        blocks = [b for p, b in zip(left.column("part").to_pylist(), left.column("block").to_pylist(), strict=True) if p < 0]
        for body in blocks[:1]:  # packs of the same name are the same
            pack = left.column("pack")[0].as_py()
            segs = _all_segments([body], length, anchor)
            if not sum(len(s.key) for s in segs):
                break
            status = _statuses(segs, right, parts)
            number, shard, chunk, first, n, query = _plan(segs, status, length, shards)
            for p, w in core.by_part(shard):
                out[0].append(p)
                out[1].append(pack)
                out[2].append(_zip(_planes(n[w]), query[w], _join(segs, first[w], n[w] + length - 1, chunk[w])))
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["shard", "pack", "block"])

    return each


def search(length: int):
    """One shard: an FM-index of its segments, and the windows of its queries that occur twice."""
    from .fm_index import FMIndex

    def each(table: pa.Table) -> pa.Table:
        packs_, ns, queries, hs, many = [], [], [], [], []
        for pack, block in zip(table.column("pack").to_pylist(), table.column("block").to_pylist(), strict=True):
            n, query, raw = _unzip(block)
            n, buf = _unplanes(n).astype(np.int64), np.frombuffer(raw, np.uint8)
            starts, ends = core.spans(buf, np.array([0, len(buf)]), core.NONBLANK)
            packs_.append(pack), ns.append(n), queries.append(np.frombuffer(query, bool)), hs.append(core.hashes(buf, starts, ends)), many.append(len(n))
        n, query, h = np.concatenate(ns), np.concatenate(queries), np.concatenate(hs)
        size = n + length - 1
        idx, run = core.groups(h)
        words = np.empty(len(h), np.int64)
        words[idx] = np.repeat(np.arange(len(run)), np.diff(np.append(run, len(h))))
        del h, idx
        begin = np.cumsum(size) - size
        # Hot segments come as single windows, and one window may come more than once: the index has all.
        index = FMIndex(words, size, length)
        asked = np.flatnonzero(query)
        found = index.matches(words[core.ragged(begin[asked], size[asked])], size[asked])
        inner = np.cumsum(size[asked]) - size[asked]
        twice = found[core.ragged(inner, n[asked])] > 1
        at = np.concatenate(([0], np.cumsum(many)))
        qat = np.searchsorted(asked, at)
        wat = np.concatenate(([0], np.cumsum(n[asked])))[qat]
        shard = table.column("shard")[0].as_py()
        return pa.table([pa.array(packs_, pa.binary()), pa.array([-2 - shard] * len(packs_), pa.int32()), pa.array([_zip(np.packbits(twice[a:b])) for a, b in zip(wat[:-1], wat[1:], strict=True)], pa.binary())], names=["pack", "part", "block"])

    return each


def _flags(segs, replies: pa.Table, parts: int, shards: int, length: int, copies: int):
    """Per chunk: which words are covered by a repeated window."""
    part = np.array(replies.column("part").to_pylist(), np.int64)
    blocks = replies.column("block")
    counted = replies.filter(pa.array(part >= 0))
    status = _statuses(segs, counted, parts)
    chunk = np.repeat(np.arange(len(segs)), [len(s.key) for s in segs])
    offset = np.cumsum([0, *(len(s.key) for s in segs)])
    first, n = np.concatenate([s.first for s in segs]), np.concatenate([s.n for s in segs])
    window_at = np.cumsum(n) - n
    flags = np.zeros(int(n.sum()), bool)
    kind = status & 3
    whole = (kind == REPEATED) | (kind == OWNER) | (copies > 1)
    flags[core.ragged(window_at[whole], n[whole])] = True
    number, shard, _, wfirst, wn, query = _plan(segs, status, length, shards)
    for p, block in zip(part.tolist(), blocks.to_pylist(), strict=True):
        if p > -2:
            continue
        w = np.flatnonzero((shard == -2 - p) & query)
        values = np.unpackbits(np.frombuffer(_unzip(block)[0], np.uint8), count=int(wn[w].sum())).astype(bool)
        to = core.ragged(window_at[number[w]] + wfirst[w] - first[number[w]], wn[w])
        flags[to] |= values
    for c, s in enumerate(segs):
        mine = slice(offset[c], offset[c + 1])
        f = np.zeros(len(s.h), np.int32)
        f[core.ragged(s.first, s.n)] = flags[window_at[offset[c]] : window_at[offset[c]] + int(n[mine].sum())] if offset[c] < len(n) else 0
        m = max(len(f) - length + 1, 0)
        yield core.covered(f[:m], length, len(f)) if m else np.zeros(len(f), bool)


def finish(parts, shards, length, anchor, row, schema):
    """Each document with its removed words: row(id, kept words, n_words, n_removed)."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        blocks = [b for p, b in zip(left.column("part").to_pylist(), left.column("block").to_pylist(), strict=True) if p < 0]
        for body in blocks:
            segs = _all_segments([body], length, anchor)
            gone = list(_flags(segs, right, parts, shards, length, len(blocks))) if sum(len(s.key) for s in segs) else [np.zeros(len(s.h), bool) for s in segs]
            for (ids, null, buf, off), s, g in zip(_bodies([body]), segs, gone, strict=True):
                raw = buf.tobytes()
                c = np.concatenate(([0], np.cumsum(g)))
                removed = (c[s.bounds[1:]] - c[s.bounds[:-1]]).tolist()
                for i, no, a, b, x, y, r in zip(ids.tolist(), null.tolist(), off[:-1].tolist(), off[1:].tolist(), s.bounds[:-1].tolist(), s.bounds[1:].tolist(), removed, strict=True):
                    words = raw[a:b].split()
                    rows.append(row(None if no else i, b" ".join(words if not r else compress(words, (~g[x:y]).tolist())), y - x, r))
        return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return each


def _run(docs, row, schema, ddl, length, anchor, hot):
    spark = docs.sparkSession
    parts = core.partitions(spark)
    shards = parts * 2
    table = "pack binary, part int, block binary"
    packed = core.docs_of(docs).mapInArrow(core.lean(packs(parts, length, anchor)), table).repartition(parts, "pack")
    hashes = core.fence(packed).where("part >= 0")
    replies = hashes.groupBy("part").applyInArrow(core.lean(settle(hot)), table).repartition(parts, "pack")
    sent = packed.groupBy("pack").cogroup(replies.groupBy("pack")).applyInArrow(core.lean(ship(parts, shards, length, anchor)), "shard int, pack binary, block binary")
    found = sent.groupBy("shard").applyInArrow(core.lean(search(length)), table)
    return packed.groupBy("pack").cogroup(replies.unionByName(found).groupBy("pack")).applyInArrow(core.lean(finish(parts, shards, length, anchor, row, schema)), ddl)


def digests(docs, length: int = 35, anchor: int = 16, hot: int = 1 << 14):
    """doc_id, n_words, n_removed and the SHA-256 of the kept words."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return _run(docs, lambda i, kept, n, r: (i, n, r, hashlib.sha256(kept).hexdigest()), schema, "doc_id long, n_words long, n_removed long, kept_sha256 string", length, anchor, hot)


def clean(docs, length: int = 35, anchor: int = 16, hot: int = 1 << 14):
    """doc_id and the text of kept words, joined by blanks."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    return _run(docs, lambda i, kept, n, r: (i, kept.decode()), schema, "doc_id long, text string", length, anchor, hot)


QUERY = "op7_substring_fm_index"


def query(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
rep AS (SELECT r, i FROM win WHERE g IN (SELECT g FROM win GROUP BY g HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS p FROM rep),
words AS (SELECT r, w[p] AS x, p FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (r, p) GROUP BY r),
n AS (SELECT r, count(*) AS n_removed FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (r) LEFT JOIN kept USING (r)
"""
