"""N-gram Jaccard join: every pair of documents whose shingle sets are similar.

A document's set is its distinct ``k``-word shingles.  Documents of equal sets
form one class; classes are joined, members are counted, not paired.

1. Survey, one scan: every document's class, written to the shared folder, and
   the shingles' frequencies in a table of 2 ** ``bits`` counters per task; the
   tables are added by slices and one byte per counter (a logarithmic level) is
   broadcast.  Sets are ordered by (level, hash): any common order is right,
   rarity only makes the candidates few.
2. Extended prefixes.  Two sets with Jaccard >= t share at least ``SHARE`` of the
   first |x| - ceil(t |x|) + SHARE shingles of the longer and
   |y| - ceil(2t/(1+t) |y|) + SHARE of the shorter, or all they must share, which
   is two or more unless the sets are equal.
3. Token classes.  A shingle in at least ``frequent`` of all sets (and ``floor``
   of them) is frequent, others are rare.  A class indexes each rare shingle of
   its prefix, and each combination of two frequent ones.  A similar pair shares
   two prefix shingles: one is rare, or both are frequent.
4. The index lies in parts, as many as the input's bytes ask for; each pairs the
   classes in its lists that pass the length and positional filters.  A pair is
   a candidate if a combination found it, or if the rare shingles it shares and
   the frequent ones that it may share are enough.  Pairs are written, and read
   again, ``MOST`` at a time: their number in a part grows with the corpus.
5. Candidates meet at a home, the least class among those they are paired
   with, so that a group's sets move there once, and are verified exactly.
6. Components: alternating star contraction over the links' spanning forests,
   each round written to the shared folder.

Defined cases: a null, empty or blank text has the empty set, n_similar 0 and
its own doc_id as component; one word alone is its own shingle; repeated rows
are documents of their own and similar to each other; null doc_ids count as
documents, and component_id is the least non-null id (null if there is none).
A doc_id must be a number: another type is cast, and what can't be cast raises.
Sets hold 64-bit hashes of shingles.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from . import core
from .bpe import _planes, _unplanes, _unzip, _zip

PACK = 8 << 20
U = np.uint64
SCHEMA = "doc_id long, n_shingles long, n_similar long, component_id long"
SLICES = 64
#: Similar sets share at least this many tokens of their extended prefixes (all that they must share, if that is less).
SHARE = 4
SCHEMA_AT = "at long, pack binary, part int, block binary"
FLAG = U(1 << 24)
#: Postings of a part that are paired at a time.
RANGE = 200_000
#: Pairs that a task holds at a time (beyond, it writes what it has, or works class by class); tokens of sets, likewise.
MOST = 2_000_000
#: A token is frequent if at least this share of all sets hold it, and at least FLOOR of them.
FREQUENT, FLOOR = 1 / 64, 16


class Sets:
    """Shingle sets of a chunk of documents: ``tokens`` sorted by (document, hash), and the ``bounds`` of documents."""

    def __init__(self, buf, off, k: int = 2):
        buf = core.LOWER[buf]
        starts, ends = core.spans(buf, off, core.NONBLANK)
        bounds = core.per_doc(off, starts)
        h = core.hashes(buf, starts, ends)
        n_words = np.diff(bounds)
        count = np.maximum(n_words - k + 1, 0)
        w = core.windows(h, k)
        tokens = w[core.ragged(bounds[:-1], count)] if len(w) else np.zeros(0, U)
        doc = np.repeat(np.arange(len(count)), count)
        for m in range(1, k):  # fewer words than a shingle: the whole sequence
            few = np.flatnonzero(n_words == m)
            if len(few):
                tokens = np.concatenate((tokens, core.mix(core.windows(h, m)[bounds[few]] + U(m))))
                doc = np.concatenate((doc, few))
        o = core.distinct_in(doc, tokens)
        self.tokens, doc = tokens[o], doc[o]
        self.bounds = np.searchsorted(doc, np.arange(len(off)))
        self.doc = doc
        self.size = np.diff(self.bounds)
        c = np.concatenate((np.zeros(1, U), np.cumsum(core.mix(self.tokens + U(77)), dtype=U)))
        self.sig = np.zeros(len(self.size), U)  # sets are too large for a signature to tell them apart
        # The class of a set: a sum over its members, whatever their order; 0 is the empty set.
        self.cls = np.where(self.size > 0, core.mix(c[self.bounds[1:]] - c[self.bounds[:-1]] + self.size.astype(U)), U(0))


class Tally:
    """How many sets hold each token, in 2 ** ``bits`` counters of 16 bits (a full one stays full)."""

    schema = "slice int, block binary"

    def __init__(self, bits: int):
        self.bits, self.total = bits, None

    def add(self, tokens):
        if self.total is None:
            self.total = np.zeros(1 << self.bits, np.uint16)
        t = (tokens >> U(64 - self.bits)).astype(np.uint32)
        t.sort()
        run = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        at = t[run]
        self.total[at] = np.minimum(self.total[at] + np.diff(np.append(run, len(t))), 0xFFFF)

    def blocks(self):
        """(slice, its counters) of what was counted."""
        width = (1 << self.bits) // SLICES
        for s in range(SLICES if self.total is not None else 0):
            part = self.total[s * width : (s + 1) * width]
            yield s, _zip((part & 0xFF).astype(np.uint8), (part >> 8).astype(np.uint8))


def levels(blocks, bits: int) -> np.ndarray:
    """A level per counter: the sum of the tasks' counters, to an eighth of a power of two; blocks: rows of ``Tally``."""
    width = (1 << bits) // SLICES

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for s, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                low, high = (np.frombuffer(x, np.uint8) for x in _unzip(block.as_py()))
                sums.setdefault(s, np.zeros(width, np.uint64))
                sums[s] += low
                sums[s] += high.astype(np.uint64) << U(8)
        for s, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([_zip(level_of(total).astype(np.uint8))], pa.binary())], names=["slice", "block"])

    out = np.zeros(1 << bits, np.uint8)
    sums = blocks.repartition(min(SLICES, core.partitions(blocks.sparkSession)), "slice").mapInArrow(core.lean(add), Tally.schema)
    for s, block in sums.collect():  # SLICES rows, 2 ** bits bytes at most
        out[s * width : (s + 1) * width] = np.frombuffer(_unzip(bytes(block))[0], np.uint8)
    return out


def level_of(count):
    return np.minimum(np.floor(8 * np.log2(np.asarray(count, np.float64) + 1)), 255)


class Order:
    """The common order of tokens, and which of them are frequent; what is broadcast."""

    def __init__(self, level: np.ndarray, n_sets: int, frequent: float, floor: int):
        self.level = level
        self.frequent = int(level_of(max(floor, frequent * n_sets)))

    def of(self, tokens):
        return self.level[(tokens >> U(65 - int(len(self.level)).bit_length())).astype(np.int64)]


def _ceil(a: int, n: np.ndarray, b: int) -> np.ndarray:
    return -(-(a * n) // b)


def probe_length(n, percent, share):
    """Prefix that shares ``share`` tokens with that of any similar set that is no longer."""
    return np.minimum(n - _ceil(percent, n, 100) + share, n)


def index_length(n, percent, share):
    """The same for any similar set that is no shorter."""
    return np.minimum(n - _ceil(2 * percent, n, 100 + percent) + share, n)


def prefixes(sets: Sets, order: Order, percent: int, share: int = SHARE):
    """(document, position, token, level) of the prefixes, by document and position; none of sets that only equal ones are similar to."""
    n = np.where(sets.size * (100 - percent) >= percent, probe_length(sets.size, percent, share), 0)
    lv = order.of(sets.tokens)
    if len(sets.size) >> 24:  # a document's number doesn't fit beside 40 bits
        o = np.lexsort((sets.tokens, core.mix(sets.tokens) >> U(32), lv, sets.doc))
    else:
        key = (sets.doc.astype(U) << U(40)) | (lv.astype(U) << U(32)) | (core.mix(sets.tokens) >> U(32))
        o = core.order(key)
        # Equal keys of different tokens: settle by the token, the same in every document.
        k = key[o]
        tie = np.flatnonzero(k[1:] == k[:-1])
        if len(tie):
            run = np.zeros(len(k), bool)
            run[tie] = run[tie + 1] = True
            where = np.flatnonzero(run)
            o[where] = o[where][np.lexsort((sets.tokens[o[where]], k[where]))]
    o = o[core.ragged(sets.bounds[:-1], n)]
    doc, pos = core.repeat_index(n)
    return doc, pos, sets.tokens[o], lv[o]


def indexed(sets: Sets, order: Order, percent: int, share: int, use: np.ndarray):
    """(token, document, position) of what the marked documents index, and per document how many frequent tokens its prefix has.

    Bit 24 of a token tells combinations of two frequent tokens from single rare ones.
    """
    doc, pos, token, level = prefixes(sets, order, percent, share)
    mine = use[doc]
    doc, pos, token, often = doc[mine], pos[mine], token[mine], level[mine] >= order.frequent
    n = np.bincount(doc[often], minlength=len(sets.size))
    rare = ~often
    out = [(token[rare] & ~FLAG, doc[rare], pos[rare])]
    doc, pos, token = doc[often], pos[often], token[often]
    begin = np.cumsum(n) - n
    left = n[doc] - (np.arange(len(doc)) - begin[doc]) - 1
    upto, a = np.cumsum(left), 0
    while a < len(doc):  # a bounded number of combinations at a time
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + 500_000, "right")))
        i = np.repeat(np.arange(a, b), left[a:b])
        j = core.ragged(np.arange(a, b) + 1, left[a:b])
        out.append((core.mix(core.mix(token[i] + U(3)) + token[j]) | FLAG, doc[i], pos[i]))
        a = b
    return out, np.minimum(n, 255)


def _in_chunks(buf, off):
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + core.CHUNK, "right")) - 1)
        yield buf[off[a] : off[b]], off[a : b + 1] - off[a]
        a = b


def picked(buf, off, mine):
    """(bytes, offsets) of the texts numbered ``mine``, in chunks."""
    n = np.diff(off)[mine]
    yield from _in_chunks(buf[core.ragged(off[mine], n)], np.concatenate(([0], np.cumsum(n))))


def signature(sets) -> np.ndarray:
    """64 bits per set, one of them for each token."""
    out = np.zeros(len(sets.size), U)
    some = np.flatnonzero(sets.size)
    if len(some):
        out[some] = np.bitwise_or.reduceat(U(1) << (sets.tokens & U(63)), sets.bounds[:-1][some])
    return out


def _postings(token, local, pos, cls, size, hot, sig):
    """One block of postings, sorted by token, of the documents numbered ``local``; their classes in a table of their own.

    Forty bits of a token are enough here: two tokens taken for one only add
    candidates, which are verified.
    """
    o = core.order(token)
    token, local, pos = token[o] >> U(24), local[o], pos[o]
    d, local = np.unique(local, return_inverse=True)
    step = np.diff(token, prepend=U(0))
    return _zip(_planes(step & U(0xFFFFFFFF)), (step >> U(32)).astype(np.uint8), cls[d], _planes(size[d]), _planes(local), _planes(pos), sig[d], hot[d].astype(np.uint8))


def blocks_of(got, sets_in_pack, parts: int):
    """(part, block) of a pack's postings; got: (token, document of the pack, position) arrays."""
    token, local, pos = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    return [(p, _postings(token[w], local[w], pos[w], *sets_in_pack)) for p, w in core.by_part((token % U(parts)).astype(np.int64))]


def packs(parts, k, percent, order_b):
    """(pack, part, block): part -1 has one text of each class, others postings."""

    def rows(texts):
        size = np.array([len(t) for t in texts], np.int64)
        off = np.concatenate(([0], np.cumsum(size)))
        cls, n, hot, got, seen = [], [], [], [], np.zeros(0, U)
        for buf, o in _in_chunks(np.frombuffer(b"".join(texts), np.uint8), off):
            s = Sets(buf, o, k)
            # Copies within the pack: one text stands for them.
            use = np.zeros(len(s.cls), bool)
            use[np.unique(s.cls, return_index=True)[1]] = True
            use &= (s.size > 0) & ~np.isin(s.cls, seen)
            seen = np.union1d(seen, s.cls[use])
            found, h = indexed(s, order_b.value, percent, SHARE, use)
            base = sum(map(len, cls))
            got += [(t, d + base, p) for t, d, p in found]
            cls.append(np.where(use, s.cls, U(0))), n.append(s.size), hot.append(h)
        cls, n, hot = (np.concatenate(x) for x in (cls, n, hot))
        keep = np.flatnonzero(cls)
        body = _zip(b"".join([texts[i] for i in keep.tolist()]), _planes(size[keep]), cls[keep])
        # Sets are too large for a signature to tell them apart.
        return packed_rows(hashlib.blake2b(body, digest_size=16).digest(), body, blocks_of(got, (cls, n, hot, np.zeros(len(cls), U)), parts))

    def run(batches):
        texts, used = [], 0
        for _, buf, off in core.chunks(batches):
            raw = buf.tobytes()
            for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                texts.append(raw[a:b])
                used += b - a
                if used > PACK or len(texts) >= 65536:
                    yield rows(texts)
                    texts, used = [], 0
        if texts:
            yield rows(texts)

    return run


def asked_sets(k):
    """Of a pack's texts, the sets of the classes that are asked for."""

    def read(body, asked):
        raw, size, cls = _unzip(body)
        off = np.concatenate(([0], np.cumsum(_unplanes(size).astype(np.int64))))
        for buf, o in picked(np.frombuffer(raw, np.uint8), off, np.flatnonzero(core.member(np.frombuffer(cls, U), asked))):
            yield Sets(buf, o, k)

    return read


def _filter(a, b, size, pos_a, pos_b, percent, share, sig):
    """Which pairs of classes pass the length, prefix, positional and signature filters.

    A bit of a that b hasn't comes from a token that b hasn't, and of these
    there can't be more than a's size less the overlap that is needed.
    """
    na, nb = size[a], size[b]
    short = np.where(na <= nb, pos_a, pos_b)
    ns, nl = np.minimum(na, nb), np.maximum(na, nb)
    most = np.minimum(pos_a, pos_b) + 1 + np.minimum(na - pos_a - 1, nb - pos_b - 1)
    ok = (100 * ns >= percent * nl) & (short < index_length(ns, percent, share)) & ((100 + percent) * most >= percent * (ns + nl))
    if sig is not None:
        at = np.flatnonzero(ok)
        x, y = sig[a[at]], sig[b[at]]
        need = _ceil(percent, na[at] + nb[at], 100 + percent)
        ok[at] = (np.bitwise_count(x & ~y) <= na[at] - need) & (np.bitwise_count(y & ~x) <= nb[at] - need)
    return ok


def at_of(name: bytes) -> int:
    """Where a pack's texts are grouped: below 0, apart from the parts of the postings."""
    return -1 - (int.from_bytes(name[:8], "little") >> 1)


def packed_rows(name: bytes, body: bytes, postings) -> pa.RecordBatch:
    """A pack's texts (part -1) and postings (part, block), keyed for one shuffle of both."""
    rows = [(at_of(name), -1, body), *((p, p, b) for p, b in postings)]
    return pa.RecordBatch.from_arrays([pa.array([a for a, _, _ in rows], pa.int64()), pa.array([name] * len(rows), pa.binary()), pa.array([p for _, p, _ in rows], pa.int32()), pa.array([b for _, _, b in rows], pa.binary())], names=["at", "pack", "part", "block"])


def pack_of(left: pa.Table) -> bytes:
    names = set(left.column("pack").to_pylist())
    if len(names) != 1:
        raise RuntimeError("texts that were asked for are missing; the input isn't repeatable")
    return names.pop()


def _read_postings(table: pa.Table):
    """Per block the sorted tokens, the classes' numbers and positions; and of all classes hash, size, a block they are in, signature, frequent tokens."""
    posts, entries = [], []
    for block in table.column("block"):
        t, high, u, z, i, q, g, h = _unzip(block.as_py())
        token = np.cumsum(_unplanes(t).astype(U) | (np.frombuffer(high, np.uint8).astype(U) << U(32)), dtype=U)
        posts.append([token, _unplanes(i).astype(np.int32), _unplanes(q).astype(np.int32)])
        g = np.frombuffer(g, U)
        entries.append((np.frombuffer(u, U), _unplanes(z), g if g.any() else None, np.frombuffer(h, np.uint8)))
    u = np.unique(np.concatenate([e[0] for e in entries]))
    size, home, sig, hot = np.zeros(len(u), np.int64), np.zeros(len(u), np.int32), np.zeros(len(u) if any(e[2] is not None for e in entries) else 0, U), np.zeros(len(u), np.uint8)
    for p, (cls, z, g, h) in enumerate(entries):  # a class may come from many packs: any stands for it
        number = np.searchsorted(u, cls).astype(np.int32)
        size[number], home[number], hot[number] = z, p, h
        if g is not None:
            sig[number] = g
        posts[p][1], entries[p] = number[posts[p][1]], None
    return posts, u, size, home, sig if len(sig) else None, hot


def _lists(posts):
    """Postings of a bounded number at a time, whole lists sorted by token; those of one posting, which pair nothing, are left out."""
    slices = -(-sum(len(t) for t, _, _ in posts) // 1_000_000)
    cuts = [np.searchsorted(t, np.arange(slices + 1, dtype=U) * U((1 << 40) // slices + 1)) for t, _, _ in posts]
    for i in range(slices):
        token, c, pos = (np.concatenate([x[j][e[i] : e[i + 1]] for x, e in zip(posts, cuts, strict=True)]) for j in range(3))
        o = core.order(token)
        token = token[o]
        same = token[1:] == token[:-1]
        keep = np.concatenate((same, [False])) | np.concatenate(([False], same)) if len(token) else np.zeros(0, bool)
        o = o[keep]
        if len(o):
            yield token[keep], c[o], pos[o]


class Found:
    """Pairs and how often they were met, up to ``share``: larger << 36 | smaller << 8 | times, in one array."""

    def __init__(self, share: int, n: int):
        if n >> 28:
            raise RuntimeError("a part of the index has 2 ** 28 classes or more")
        self.share, self.packed = share, np.zeros(0, U)
        self.fresh, self.waiting = [], 0

    def add(self, x, y, worth: int):
        self.fresh.append((np.maximum(x, y) << U(36)) | (np.minimum(x, y) << U(8)) | U(worth))
        self.waiting += len(x)
        if self.waiting > max(500_000, len(self.packed) // 2):
            self.merge()

    def merge(self):
        k = np.concatenate((self.packed, *self.fresh))
        self.packed, self.fresh, self.waiting = k, [], 0
        k.sort()
        if len(k):
            start = np.flatnonzero(np.concatenate(([True], (k[1:] ^ k[:-1]) > U(255))))
            times = np.minimum(np.add.reduceat((k & U(255)).astype(np.uint8), start, dtype=np.uint32), self.share)
            self.packed = (k[start] & ~U(255)) | times.astype(U)

    def take(self):
        """(larger, smaller, times) of what was found; it starts anew."""
        self.merge()
        k, self.packed = self.packed, np.zeros(0, U)
        return (k >> U(36)).astype(np.int64), ((k >> U(8)) & U((1 << 28) - 1)).astype(np.int64), (k & U(255)).astype(np.uint8)


def pairs(parts, percent, share):
    """One part of the index: candidate pairs by the part of the larger class, at most about ``MOST`` at a time; in place of the pack's name, their number."""

    def each(table: pa.Table) -> pa.Table:
        out = ([], [], [])
        if table.column("part")[0].as_py() < 0:  # texts, which the same shuffle brings
            return pa.table([pa.array([], pa.int32()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["part", "pack", "block"])
        names = table.column("pack").to_pylist()
        posts, u, size, home, sig, hot = _read_postings(table)
        found, width = Found(share, len(u)), int(size.max(initial=0)) * 100 // percent + 2

        def write():
            big, small, times = found.take()
            for p, w in core.by_part((u[big] % U(parts)).astype(np.int64)):
                x, y = big[w], small[w]
                d = np.unique(np.concatenate((x, y)))
                packs_, at = np.unique(home[d], return_inverse=True)
                # Pairs in order of (larger, smaller), as steps: dense groups compress to almost nothing.
                bi, si = np.searchsorted(d, x), np.searchsorted(d, y)
                out[0].append(p), out[1].append(len(w).to_bytes(8, "little")), out[2].append(_zip(u[d], _planes(size[d]), b"".join(names[q] for q in packs_.tolist()), _planes(at), _planes(np.diff(bi, prepend=0)), _planes(si), times[w], hot[d]))

        for token, c, pos in _lists(posts):
            start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            length = np.diff(np.append(start, len(token)))
            upto, a = np.cumsum(length), 0
            while a < len(start):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + RANGE, "right")))
                at = core.ragged(start[a:b], length[a:b])
                run = np.repeat(np.arange(b - a), length[a:b])
                # One posting of a class in a list, the first; within a list by size: partners are those that follow, up to the largest size that can be similar.
                key = run * len(u) + c[at]
                o = np.argsort(key, kind="stable")
                keep = np.sort(o[np.concatenate(([True], key[o][1:] != key[o][:-1]))])
                at, run = at[keep], run[keep]
                key = run * width + size[c[at]]
                o = np.argsort(key, kind="stable")
                key, ck, pk = key[o], c[at[o]].astype(np.int64), pos[at[o]]
                single = (token[start[a:b]] & U(1)) == 0
                last = np.searchsorted(key, key - size[ck] + size[ck] * 100 // percent, "right")
                left = last - np.arange(len(key)) - 1
                a = b
                for kind, worth in ((True, 1), (False, share)):  # a combination has two tokens in common
                    rows = np.flatnonzero((left > 0) & (single[run[o]] == kind))
                    many, step = np.cumsum(left[rows]), 0
                    while step < len(rows):  # a bounded number of pairs at a time
                        end = max(step + 1, int(np.searchsorted(many, (many[step - 1] if step else 0) + 300_000, "right")))
                        i = np.repeat(rows[step:end], left[rows[step:end]])
                        j = core.ragged(rows[step:end] + 1, left[rows[step:end]])
                        step = end
                        ok = _filter(ck[i], ck[j], size, pk[i], pk[j], percent, share, sig)
                        found.add(ck[i[ok]].astype(U), ck[j[ok]].astype(U), worth)
                        if len(found.packed) > MOST:
                            write()
        write()
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["part", "pack", "block"])

    return each


def gather(parts, percent, share):
    """All candidates of a part of larger classes: by home, the pairs (part >= 0), and by pack, the sets to send (part -1).

    A pair must share ``share`` prefix tokens, or all that it must share at
    all.  The frequent ones weren't counted one by one: each may be shared.
    """

    def each(table: pa.Table) -> pa.Table:
        out = ([], [], [])
        total = sum(int.from_bytes(n, "little") for n in table.column("pack").to_pylist())
        passes = max(1, -(-total // MOST))
        for i in range(passes):  # all pairs of a larger class in one pass
            cls, size, pack, big, small, times, hot, base = [], [], [], [], [], [], [], 0
            for block in table.column("block"):
                u, z, names, at, b, s, n, h = _unzip(block.as_py())
                u, z, at, b, s = np.frombuffer(u, U), _unplanes(z), _unplanes(at), np.cumsum(_unplanes(b).astype(np.int64)), _unplanes(s).astype(np.int64)
                n, h = np.frombuffer(n, np.uint8), np.frombuffer(h, np.uint8)
                if passes > 1:
                    mine = (core.mix(u) % U(passes) == U(i))[b]
                    b, s, n = b[mine], s[mine], n[mine]
                    used = np.zeros(len(u), bool)
                    used[b] = used[s] = True
                    place = np.cumsum(used) - 1
                    b, s, u, z, at, h = place[b], place[s], u[used], z[used], at[used], h[used]
                cls.append(u), size.append(z), pack.append(np.frombuffer(names, "V16")[at]), times.append(n), hot.append(h)
                big.append(b + base), small.append(s + base)
                base += len(u)
            if not base:
                continue
            cls, size, pack, big, small, times, hot = (np.concatenate(x) for x in (cls, size, pack, big, small, times, hot))
            u, first, number = np.unique(cls, return_index=True, return_inverse=True)
            pack, size, hot = pack[first], size[first].astype(np.int64), hot[first].astype(np.int64)
            key, inverse = np.unique((number[big].astype(U) << U(32)) | number[small].astype(U), return_inverse=True)
            times = np.bincount(inverse, weights=times)
            del cls, number, first, inverse
            big, small = (key >> U(32)).astype(np.int64), (key & U(0xFFFFFFFF)).astype(np.int64)
            must = np.minimum(_ceil(percent, size[big] + size[small], 100 + percent), share)
            ok = times + np.minimum(hot[big], hot[small]) >= must
            big, small = big[ok], small[ok]
            del key, times, must, ok
            first = np.flatnonzero(np.concatenate(([True], big[1:] != big[:-1]))) if len(big) else big
            home = np.repeat(small[first], np.diff(np.append(first, len(big))))  # the least class that the larger one is paired with
            for p, w in core.by_part((u[home] % U(parts)).astype(np.int64)):
                b, s = big[w], small[w]
                d = np.unique(np.concatenate((b, s)))
                out[0].append(p), out[1].append(b""), out[2].append(_zip(u[d], _planes(np.searchsorted(d, b)), _planes(np.searchsorted(d, s))))
                for q in np.unique(pack[d]):
                    mine = d[pack[d] == q]
                    out[0].append(-1 - p), out[1].append(q.tobytes()), out[2].append(_zip(u[mine]))
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["part", "pack", "block"])

    return each


def send(sets_in):
    """The sets that homes asked a pack for, once per part of homes."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        out = ([], [], [])
        wanted: dict[int, list] = {}
        for p, block in zip(right.column("part").to_pylist(), right.column("block").to_pylist(), strict=True):
            wanted.setdefault(-1 - p, []).append(np.frombuffer(_unzip(block)[0], U))
        if wanted:
            pack = pack_of(left)
            body = next(b for p, b in zip(left.column("part").to_pylist(), left.column("block").to_pylist(), strict=True) if p == -1)
            sets = list(sets_in(body, np.unique(np.concatenate([x for y in wanted.values() for x in y]))))
            for p, asked in wanted.items():
                asked = np.unique(np.concatenate(asked))
                cls, size, tokens = [], [], []
                for s in sets:
                    d = np.flatnonzero(core.member(s.cls, asked))
                    d = d[np.unique(s.cls[d], return_index=True)[1]]
                    asked_here = ~np.isin(s.cls[d], np.concatenate(cls)) if cls else np.ones(len(d), bool)
                    d = d[asked_here]
                    cls.append(s.cls[d]), size.append(s.size[d]), tokens.append(s.tokens[core.ragged(s.bounds[d], s.size[d])])
                cls = np.concatenate(cls)
                if len(cls) != len(asked):
                    raise RuntimeError("the sets of a pack changed while they were joined; its input isn't repeatable")
                # Shared tokens are written once; sorted tokens and their places in the sets go as steps, which compress.
                size, (u, place) = np.concatenate(size), np.unique(np.concatenate(tokens), return_inverse=True)
                step = np.diff(u, prepend=U(0))
                place = place + np.repeat(np.arange(len(size)), size) * len(u)
                out[0].append(p), out[1].append(pack), out[2].append(_zip(cls, _planes(size), _planes(step & U(0xFFFFFFFF)), _planes(step >> U(32)), _planes(np.diff(place, prepend=0))))
        return pa.table([pa.array(out[0], pa.int32()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["part", "pack", "block"])

    return each


def verify(percent):
    """The candidates of a part of homes, verified: links as (a, b, in_forest)."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        # Tokens are numbered: first all that occur, block by block, then the sets.
        known, waiting = np.zeros(0, U), []

        def steps(low, high):
            return np.cumsum(_unplanes(low).astype(U) | (_unplanes(high).astype(U) << U(32)), dtype=U)

        for block in right.column("block"):
            _, _, low, high, _ = _unzip(block.as_py())
            waiting.append(steps(low, high))
            if sum(map(len, waiting)) > max(MOST, len(known)):
                known, waiting = np.unique(np.concatenate((known, *waiting))), []
        known, waiting = np.unique(np.concatenate((known, *waiting))), []
        cls, size, tokens = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for block in right.column("block"):
            c, z, low, high, place = _unzip(block.as_py())
            z = _unplanes(z).astype(np.int64)
            n = np.searchsorted(known, steps(low, high)).astype(np.int32)
            place = np.cumsum(_unplanes(place).astype(np.int64)) - np.repeat(np.arange(len(z)), z) * len(n)
            cls.append(np.frombuffer(c, U)), size.append(z), tokens.append(n[place])
        cls, size, tokens = np.concatenate(cls), np.concatenate(size), np.concatenate(tokens)
        at = np.cumsum(size) - size
        u, first = np.unique(cls, return_index=True)
        size, at = size[first], at[first]
        mark = np.zeros(len(known) + 1, bool)
        bs, as_ = [], []
        for block in left.column("block").to_pylist():
            c, b, s = _unzip(block)
            c = np.searchsorted(u, np.frombuffer(c, U))
            bs.append(c[_unplanes(b)]), as_.append(c[_unplanes(s)])
        big, small = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (bs, as_))
        o = np.argsort(big, kind="stable")
        big, small = big[o], small[o]
        starts = np.flatnonzero(np.concatenate(([True], big[1:] != big[:-1]))) if len(big) else []
        out_a, out_b, forest = [], [], []
        root = np.arange(len(u))

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for a, e in zip(starts, [*starts[1:], len(big)] if len(big) else [], strict=True):
            b = big[a]
            own = tokens[at[b] : at[b] + size[b]]
            mark[own] = True
            for f in range(a, e, 1024):
                s = small[f : min(f + 1024, e)]
                hits = mark[tokens[core.ragged(at[s], size[s])]]
                inter = np.add.reduceat(hits, np.cumsum(size[s]) - size[s], dtype=np.int64)
                good = s[(100 + percent) * inter >= percent * (size[s] + size[b])]
                for x in good.tolist():
                    rx, rb = find(x), find(b)
                    forest.append(rx != rb)
                    if rx != rb:
                        root[max(rx, rb)] = min(rx, rb)
                out_a.append(u[good]), out_b.append(np.full(len(good), u[b], U))
            mark[own] = False
        cat = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
        return pa.table([pa.array(cat(out_a)), pa.array(cat(out_b)), pa.array(forest, pa.bool_())], names=["a", "b", "forest"])

    return each


def survey(docs, k, bits):
    """doc_id, class and set size of every document; and, in rows with a slice, the tasks' counters."""

    def run(batches):
        tally = Tally(bits)
        for batch, buf, off in core.chunks(batches):
            s = Sets(buf, off, k)
            tally.add(s.tokens)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s.cls.view(np.int64)), pa.array(s.size.astype(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=["doc_id", "cls", "n_shingles", "slice", "block"])
        for number, block in tally.blocks():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([number], pa.int32()), pa.array([block], pa.binary())], names=["doc_id", "cls", "n_shingles", "slice", "block"])

    return docs.mapInArrow(core.lean(run), "doc_id long, cls long, n_shingles long, " + Tally.schema)


def components(edges):
    """node -> least node reachable, by alternating large-star and small-star steps.

    edges: a, b with a < b.  Each round is written to the shared folder; the
    number of rounds grows with the logarithm of the largest component.
    """
    from pyspark.sql import functions as F

    edges = core.save(edges.select("a", "b").distinct())
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()
        down = large  # a < b: every node with its smaller neighbours
        low = down.groupBy(F.col("b").alias("b")).agg(F.min("a").alias("m"))
        small = down.join(low, "b").select("a", "b", "m")
        new = core.save(small.select(F.col("m").alias("a"), F.col("b")).unionByName(small.select(F.col("m").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
        left = edges.join(new, ["a", "b"], "left_anti").limit(1).count() + new.join(edges, ["a", "b"], "left_anti").limit(1).count()
        edges = new
        if not left:
            return edges.select(F.col("b").alias("cls"), F.col("a").alias("root"))


def linked(packed, parts, sets_in, percent, share=SHARE):
    """Links (a, b, forest) between the classes of packs; ``sets_in`` reads the sets of a pack's texts.

    One query, so that the packs' shuffle, the candidates' and the homes' are each written once and read again.
    """
    by_part = "part int, pack binary, block binary"
    lean, fence = core.lean, core.fence

    def to_packs(df):
        """Requests keyed as the texts are."""

        def keyed(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([at_of(x) for x in b.column(1).to_pylist()], pa.int64()), b.column(1), b.column(0), b.column(2)], names=["at", "pack", "part", "block"])

        return df.mapInArrow(keyed, SCHEMA_AT).groupBy("at")

    first = packed.groupBy("at").applyInArrow(lean(pairs(parts, percent, share)), by_part).repartition(parts, "part")
    homes = first.groupBy("part").applyInArrow(lean(gather(parts, percent, share)), by_part).repartition(parts, "part")
    sets = packed.groupBy("at").cogroup(to_packs(fence(homes).where("part < 0"))).applyInArrow(lean(send(sets_in)), by_part).repartition(parts, "part")
    return fence(homes).where("part >= 0").groupBy("part").cogroup(sets.groupBy("part")).applyInArrow(lean(verify(percent)), "a long, b long, forest boolean")


def classes(docs, k: int = 2, percent: int = 60, frequent: float = FREQUENT, floor: int = FLOOR, bits: int = 24):
    """(members, per class: size, least doc_id, similar documents of other classes, component root)."""
    from pyspark.sql import functions as F

    spark = docs.sparkSession
    parts = core.parts(docs)
    docs = core.docs_of(docs)
    surveyed = core.save(survey(docs, k, bits))
    who = surveyed.where("slice IS NULL").select("doc_id", "cls", "n_shingles")
    order = spark.sparkContext.broadcast(Order(levels(surveyed.where("slice IS NOT NULL").select("slice", "block"), bits), who.where("cls <> 0").count(), frequent, floor))
    packed = docs.mapInArrow(core.lean(packs(parts, k, percent, order)), SCHEMA_AT).repartition(core.partitions(spark), "at")
    links = core.save(linked(packed, parts, asked_sets(k), percent))
    order.destroy()
    per = who.where("cls <> 0").groupBy("cls").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"))
    ends = links.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")
    similar = ends.join(per.select(F.col("cls").alias("b"), "n"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))
    forest = links.where("forest").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = components(forest)
    rooted = per.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    lowest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return who, rooted.join(lowest, "root").join(similar, "cls", "left").select("cls", "n", "least", "component_id", "root", F.coalesce("others", F.lit(0)).alias("others"))


def report(docs, k: int = 2, percent: int = 60, frequent: float = FREQUENT, floor: int = FLOOR, bits: int = 24):
    """One row per document: size of its set, number of similar documents, component."""
    from pyspark.sql import functions as F

    who, per = classes(docs, k, percent, frequent, floor, bits)
    # Only classes that differ from "one document, no link" are joined.
    other = per.where("n > 1 OR others > 0").select("cls", "n", "component_id", "others")
    out = who.join(other, "cls", "left")
    return out.select("doc_id", "n_shingles", F.coalesce(F.col("n") - 1 + F.col("others"), F.lit(0)).alias("n_similar"), F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def clean(docs, k: int = 2, percent: int = 60, frequent: float = FREQUENT, floor: int = FLOOR, bits: int = 24):
    """The documents, all columns, without those similar to another: of each component that of the least doc_id stays.

    Of rows with one doc_id and one set, one stays; so do documents with the
    empty set, all of them.  Documents without an id go if they are similar to
    one that has an id; else one of each class stays.
    """
    from pyspark.sql import functions as F

    names, schema = docs.columns, docs.schema
    mark, gone_id, gone_cls = core.fresh(names, "class", "gone_id", "gone_cls")
    who, per = classes(docs, k, percent, frequent, floor, bits)
    repeats = who.where("cls <> 0").groupBy("doc_id", "cls").count().where("count > 1")
    gone = who.join(per.where("n > 1 OR others > 0").select("cls", "component_id"), "cls").where("NOT doc_id <=> component_id").select(F.col("doc_id").alias(gone_id), F.col("cls").alias(gone_cls)).distinct()

    def classed(batches):
        for batch, buf, off in core.chunks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(Sets(buf, off, k).cls.view(np.int64))], names=[*names, mark])

    rows = docs.mapInArrow(classed, type(schema)([*schema.fields, *type(schema)().add(mark, "long").fields]))
    kept = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(gone_id)) & (F.col(mark) == F.col(gone_cls)), "left_anti")
    if repeats.limit(1).count():
        kept = kept.where(F.col(mark) != 0).dropDuplicates(["doc_id", mark]).unionByName(kept.where(F.col(mark) == 0))
    return kept.select(*names)


QUERY = "op8_ngram_jaccard"


def query(spark, sf_dir):
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
  FROM documents
),
s AS (
  SELECT DISTINCT r, array_to_string(w[i : i + 1], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w), 2))) AS i FROM d WHERE len(w) > 0)
),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
inter AS (SELECT a.r AS x, b.r AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
link AS (SELECT x, y FROM inter JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * k >= 60 * (a.n + b.n - k)),
reach(x, y) AS (SELECT r, r FROM d UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, (SELECT count(*) FROM link WHERE link.x = d.r) AS n_similar,
       min(e.doc_id) AS component_id
FROM d LEFT JOIN n USING (r) JOIN reach ON reach.x = d.r JOIN d e ON e.r = reach.y
GROUP BY d.r, d.doc_id
"""
