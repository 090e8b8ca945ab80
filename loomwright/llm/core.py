"""Shared machinery of the text operators: Arrow buffers in, numpy arrays out.

All per-word work runs on whole UTF-8 buffers.  A *chunk* is a slice of an
Arrow batch holding a bounded number of text bytes; words are maximal runs of
bytes that a 256-entry table marks, and never span two documents.  Word hashes
are 64-bit: a prefix-sum polynomial over randomised bytes, finished with a
mixing step, so hashing n words costs O(bytes) vector operations.
"""

from __future__ import annotations

import ctypes
import hashlib
import inspect
import os

import numpy as np
import pyarrow as pa

from .. import shared

# Freed memory must be able to leave an idle worker: no pool of Arrow's own, and ``trim`` after each task.
pa.set_memory_pool(pa.system_memory_pool())
try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # not glibc
    _libc = None

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Words of op 4, 5, 7, 8 and 10: anything but the six ASCII blanks.
NONBLANK = ~SPACE
#: Words of op 2: digits, lower-case letters, every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

CHUNK = 1 << 20
#: Spans of more bytes than this are hashed one by one.
LONG = 256
_P = 0x9E3779B97F4A7C15 | 1
_PI = pow(_P, -1, 1 << 64)
_T = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(U) | U(1)
_pow = {"n": 0, "p": np.ones(1, U), "i": np.ones(1, U)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _pow["n"] < n:
        m = max(n, CHUNK + (CHUNK >> 1))
        for k, base in (("p", _P), ("i", _PI)):
            a = np.full(m + 1, base, U)
            a[0] = 1
            np.multiply.accumulate(a, out=a)
            _pow[k] = a
        _pow["n"] = m
    return _pow["p"], _pow["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every input bit."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string or binary column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    binary = pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type)
    col = col.cast(pa.large_binary() if binary else pa.large_string())
    if col.null_count:
        col = col.fill_null(b"" if binary else "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches, text: str = "text", limit: int = CHUNK):
    """Yield (batch slice, bytes, offsets) with at most ``limit`` bytes, or one row."""
    for batch in batches:
        buf, off = buffers(batch.column(batch.schema.get_field_index(text)))
        a, n = 0, batch.num_rows
        while a < n:
            b = min(max(a + 1, int(np.searchsorted(off, off[a] + limit, "right")) - 1), a + 65536)
            yield batch.slice(a, b - a), buf[off[a] : off[b]], off[a : b + 1] - off[a]
            a = b


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of marked bytes, cut at documents."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = table[buf]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~prev | edge[:n]))
    following = np.empty(n, bool)
    following[-1], following[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~following | edge[1:])) + 1
    return starts, ends


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for each span; equal bytes, equal hash."""
    p, inv = _powers(len(buf))
    c = np.zeros(len(buf) + 1, U)
    np.cumsum(_T[buf] * p[: len(buf)], out=c[1:])
    out = mix((c[ends] - c[starts]) * inv[starts] + U(0x5851F42D4C957F2D))
    long = np.flatnonzero(ends - starts > LONG)
    if len(long):  # a polynomial modulo a power of two has known collisions of long strings
        raw = memoryview(np.ascontiguousarray(buf))
        out[long] = [int.from_bytes(hashlib.blake2b(raw[a:b], digest_size=8).digest(), "little") for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)]
    return out


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive entries of h; n - k + 1 of them (or none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out *= U(_P)
        out += h[j : j + n]
    return mix(out)


def per_doc(off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """n + 1 boundaries: positions in the sorted array ``at`` where documents begin."""
    return np.searchsorted(at, off, "left")


def repeat_index(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ragged gathers: owner and rank within owner of each element."""
    owner = np.repeat(np.arange(len(counts)), counts)
    begin = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - begin[owner]


def ragged(start: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices start[i], start[i] + 1, ... (counts[i] of them), one after another."""
    begin = np.cumsum(counts) - counts
    return np.arange(int(counts.sum())) + np.repeat(start - begin, counts)


def order(keys: np.ndarray) -> np.ndarray:
    """A stable argsort of uint64 hashes; packs position into the low bits, which
    sorts far faster than argsort, and settles equal high bits exactly."""
    n = len(keys)
    bits = max(1, int(n).bit_length())
    low = U((1 << bits) - 1)
    packed = np.sort((keys & ~low) | np.arange(n, dtype=U))
    idx = (packed & low).astype(np.int64)
    high = packed >> U(bits)
    same = np.flatnonzero(high[1:] == high[:-1])
    if len(same):  # runs that share the high bits may differ in the low ones
        k = keys[idx]
        if (k[same] > k[same + 1]).any() or (k[same] != k[same + 1]).any():
            run = np.zeros(n, bool)
            run[same] = run[same + 1] = True
            where = np.flatnonzero(run)
            sub = np.lexsort((idx[where], k[where]))
            idx[where] = idx[where][sub]
    return idx


def distinct_in(owner: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Positions of the distinct (owner, token) pairs, by owner and token."""
    if len(owner) and int(owner.max()) >> 20:  # an owner doesn't fit beside 44 bits of a token
        idx = np.lexsort((tokens, owner))
        t, o = tokens[idx], owner[idx]
        return idx[np.concatenate(([True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])))]
    key = (owner.astype(U) << U(44)) | (tokens >> U(20))
    idx = order(key)
    k = key[idx]
    tie = np.flatnonzero(k[1:] == k[:-1])
    t = tokens[idx]
    if len(tie) and (t[tie] != t[tie + 1]).any():  # different tokens that share 44 bits
        run = np.zeros(len(k), bool)
        run[tie] = run[tie + 1] = True
        where = np.flatnonzero(run)
        idx[where] = idx[where][np.lexsort((tokens[idx[where]], k[where]))]
        t = tokens[idx]
    o = owner[idx]
    return idx[np.concatenate(([True], (t[1:] != t[:-1]) | (o[1:] != o[:-1])))] if len(idx) else idx


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of the runs of equal keys within that order)."""
    idx = order(keys)
    k = keys[idx]
    return idx, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)


def repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    s = np.sort(keys)
    twice = s[1:][s[1:] == s[:-1]]
    return member(keys, twice[np.concatenate(([True], twice[1:] != twice[:-1]))] if len(twice) else twice)


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which keys are in the sorted array ``among``; a bitmap settles most."""
    out = np.zeros(len(keys), bool)
    if not len(among) or not len(keys):
        return out
    bits = min(24, max(16, int(len(among)).bit_length() + 4))
    maybe = np.zeros(1 << bits, bool)
    maybe[(among >> U(64 - bits)).astype(np.int64)] = True
    c = np.flatnonzero(maybe[(keys >> U(64 - bits)).astype(np.int64)])
    k = keys[c]
    at = np.searchsorted(among, k)
    at[at == len(among)] = 0
    out[c] = among[at] == k
    return out


def covered(flags: np.ndarray, k: int, n: int) -> np.ndarray:
    """Of n words, those inside any flagged window of k words (flags: n - k + 1 or fewer)."""
    d = np.zeros(n + 1, np.int32)
    d[: len(flags)] += flags
    d[k : k + len(flags)] -= flags
    return np.cumsum(d[:n]) > 0


def word_docs(bounds: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def shared_dir(spark) -> str:
    """A new directory in the cluster's shared folder, as the session names it; unset, it raises but in a local session."""
    return shared.folder(spark)


#: Tables that ``save`` wrote, oldest first.
saved: list[str] = []


def save(df, spark=None):
    """Cut the lineage: write to the shared folder as Parquet, and read it again."""
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", "zstd").parquet(path)
    saved.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark, paths) -> None:
    """Delete saved tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in list(paths):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        if path in saved:
            saved.remove(path)


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary lies: $PUBLIC_TOKENIZERS, or the installed package."""
    if root := os.environ.get("PUBLIC_TOKENIZERS"):
        return os.path.join(root, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def partitions(spark) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df) -> int | None:
    """The optimizer's estimate of the bytes of the tables that are read; None where it has none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.length()))
    return n if n < 1 << 60 else None


def parts(df, each: int = 32 << 20, most: int = 1 << 30) -> int:
    """Parts of an index over a table: one for each ``each`` bytes, up to 4,096; larger ones, of at most ``most`` bytes, beyond.

    Few parts keep blocks (one for each pack and part) large and repetitions of
    a document between parts rare; tasks work through a part piece by piece.
    """
    n = input_bytes(df)
    if n is None:
        return max(12, partitions(df.sparkSession))
    return max(12, -(-n // most), min(4096, -(-n // each)))


def fresh(taken, *names: str) -> list[str]:
    """Column names that aren't taken, whatever their case."""
    taken = {t.lower() for t in taken}
    out = []
    for n in names:
        n = f"_{n}_"
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def docs_of(df, id_col: str = "doc_id", text_col: str = "text", *more: str):
    """Only the needed columns, so that no other column can clash."""
    from pyspark.sql import functions as F

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *(F.col(c) for c in more))


def by_part(part: np.ndarray):
    """(part, indices) groups in ascending order of part; indices ascend within each."""
    if not len(part):
        return
    by = np.argsort(part, kind="stable")
    p = part[by]
    cuts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1]))).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(p)], strict=True):
        yield int(p[a]), by[a:b]


def trim() -> None:
    """Give freed memory back to the system; workers stay alive between tasks."""
    if hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def lean(f):
    """A function for mapInArrow or applyInArrow that trims memory when it is done."""
    if inspect.isgeneratorfunction(f):

        def run(batches):
            yield from f(batches)
            trim()

        return run
    if len(inspect.signature(f).parameters) == 2:

        def both(left, right):
            try:
                return f(left, right)
            finally:
                trim()

        return both

    def one(table):
        try:
            return f(table)
        finally:
            trim()

    return one


def fence(df):
    """The same rows; no filter above is moved below, so that a shuffle under it can be used again."""
    from pyspark.sql import functions as F

    return df.where(F.monotonically_increasing_id() >= 0)
