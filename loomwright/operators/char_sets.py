"""Near copies by the set of their characters: an exact Jaccard join that counts pairs without sending them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: Up to this level sets must agree on two parts of the alphabet, beyond it on one, as the choices of parts grow.
TWO_PARTS = 4


def char_sets(d: DataFrame) -> DataFrame:
    """d (doc_id, text) -> (doc_id, s): the sorted distinct characters of the whole text, where there are any."""
    kind = d.select("doc_id").schema.add("s", "string")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            sets = [t and "".join(sorted(set(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.string())], names=["doc_id", "s"])

    return d.select("doc_id", "text").mapInArrow(run, kind).where("s <> ''")


def char_similar(d: DataFrame, percent: int) -> DataFrame:
    """d (doc_id, s: sorted distinct characters) -> doc_id, class_id, n_similar; similar: Jaccard above ``percent`` per cent."""
    d = written(d)
    c = written(d.groupBy("s").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n")))
    m = char_links(c, percent).groupBy("class_id").agg(F.sum("m").alias("m"))
    return d.join(c, "s").join(m, "class_id", "left").select("doc_id", "class_id", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("n_similar"))


def differ(z: int, percent: int) -> int:
    """In how many characters a set of ``z`` may differ from a similar one that isn't smaller."""
    return max(((100 - percent) * z - 1) // percent, 0)


def levels(z: int, percent: int) -> list[int]:
    """The levels at which a set of ``z`` meets others: its own, and those of smaller sets that may reach it; at 0 there is nothing to find."""
    own = differ(z, percent)
    return sorted({own, *(k for y in range(max(z - own, 1), z) if y + (k := differ(y, percent)) >= z)} - {0})


def char_links(c: DataFrame, percent: int) -> DataFrame:
    """c (s, class_id, n), each s once -> (class_id, m): partial sums of the n of the other sets that are similar.

    A pair belongs to the level ``differ`` of its smaller set.  There the
    alphabet is dealt into one or two parts more than may differ, so similar
    sets agree on one or two whole parts: they meet by the contents of each
    choice of parts, are compared as bits, and count at the first parts that
    they agree on.  A task holds a batch and its last bucket.
    """
    import numpy as np

    def count(batches):
        from collections import Counter

        import pyarrow as pa

        every = Counter()
        for batch in batches:
            for s in batch.column(0).to_pylist():
                every.update(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64())], names=["ch", "n"])

    df = {r["ch"]: r["n"] for r in c.select("s").mapInArrow(count, "ch string, n long").groupBy("ch").agg(F.sum("n").alias("n")).collect()}  # a row per character
    total, largest = c.agg(F.count("*"), F.coalesce(F.max(F.length("s")), F.lit(0))).first()
    alphabet = np.array(sorted(map(ord, df)), np.uint32)
    words = max(-(-len(alphabet) // 64), 1)
    telling = sorted(range(len(alphabet)), key=lambda i: (abs(2 * df[chr(alphabet[i])] - total), i))  # those in half of the sets first
    choices, masks, sums = {}, {}, {}
    for k in sorted({k for z in range(1, largest + 1) for k in levels(z, percent)}):
        n_parts = k + (2 if k <= TWO_PARTS else 1)
        bits = np.zeros((n_parts, words * 64), bool)
        for at, i in enumerate(telling):
            turn, part = divmod(at, n_parts)
            bits[part if turn % 2 == 0 else n_parts - 1 - part, i] = True
        masks[k] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        choices[k] = np.array([[p in some for p in range(n_parts)] for some in itertools.combinations(range(n_parts), n_parts - k)])
        sums[k] = np.array([np.bitwise_or.reduce(masks[k][some], axis=0) for some in choices[k]])
    at_levels = {z: levels(z, percent) for z in range(largest + 1)}
    rng = np.random.default_rng(7)
    odd = rng.integers(0, 1 << 63, words, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def place(batches):
        import pyarrow as pa

        step = max((1 << 24) // (words * 64), 1)
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                texts = batch.column(0).to_pylist()
                z = np.fromiter(map(len, texts), np.int64, len(texts))
                bits = np.zeros((len(texts), words * 64), bool)
                bits[np.repeat(np.arange(len(texts)), z), np.searchsorted(alphabet, np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32))] = True
                sets = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
                mine = [at_levels[x] for x in z.tolist()]
                for k in sorted({k for ks in mine for k in ks}):
                    rows = np.array([i for i, ks in enumerate(mine) if k in ks])
                    held = pa.array(map(bytes, sets[rows]), pa.binary())
                    for choice, mask in enumerate(sums[k]):
                        key = np.full(len(rows), k * 1_000_003 + choice, np.uint64)
                        for w in range(words):
                            key = (key ^ (key >> np.uint64(29)) ^ (sets[rows, w] & mask[w])) * odd[w]
                        same = lambda x: pa.array(np.full(len(rows), x, np.int32))  # noqa: E731, B023
                        yield pa.RecordBatch.from_arrays([same(k), same(choice), pa.array(key.view(np.int64)), batch.column(1).take(pa.array(rows)), pa.array(z[rows]), batch.column(2).take(pa.array(rows)), held], names=["k", "choice", "key", "class_id", "z", "n", "bits"])

    def links(k, choice, key, z, n, sets):
        """The m of each row: of pairs in one bucket (k, choice, key), a distance in the order at a time."""
        m = np.zeros(len(z), np.int64)
        new = np.flatnonzero((k[1:] != k[:-1]) | (choice[1:] != choice[:-1]) | (key[1:] != key[:-1])) + 1
        end = np.repeat([*new, len(z)], np.diff([0, *new, len(z)]))
        a, apart = np.arange(len(z)), 0
        while len(a := a[a + (apart := apart + 1) < end[a]]):
            for x in np.array_split(a, -(-len(a) * words // (1 << 20))):
                y = x + apart
                gap = np.bitwise_count(sets[x] ^ sets[y]).sum(axis=1, dtype=np.int64)
                low = np.maximum(((100 - percent) * np.minimum(z[x], z[y]) - 1) // percent, 0)
                x = x[((100 - percent) * (z[x] + z[y]) > (100 + percent) * gap) & (low == k[x])]
                for level in np.unique(k[x]).tolist():
                    p = x[k[x] == level]
                    apart_ = sets[p] ^ sets[p + apart]
                    agree = np.stack([~(apart_ & part).any(axis=1) for part in masks[level]], axis=1)
                    first = agree & (np.cumsum(agree, axis=1) <= agree.shape[1] - level)
                    p = p[(first == choices[level][choice[p]]).all(axis=1)]
                    np.add.at(m, p, n[p + apart])
                    np.add.at(m, p + apart, n[p])
        return m

    def meet(batches):
        import pyarrow as pa

        def found(t):
            k, choice, key, z, n = (t.column(x).to_numpy() for x in ("k", "choice", "key", "z", "n"))
            sets = np.frombuffer(b"".join(t.column("bits").to_pylist()), np.uint64).reshape(-1, words)
            m = links(k, choice, key, z, n, sets)
            t = pa.table({"class_id": t.column("class_id"), "m": pa.array(m)}).filter(pa.array(m > 0)).group_by("class_id").aggregate([("m", "sum")])
            return pa.table({"class_id": t.column("class_id"), "m": t.column("m_sum")}).to_batches()

        held = []
        for batch in batches:
            if not batch.num_rows:
                continue
            last = [batch.column(i)[batch.num_rows - 1].as_py() for i in range(3)]
            if held and [held[0].column(i)[held[0].num_rows - 1].as_py() for i in range(3)] == last:  # the whole batch belongs to the bucket that is open
                held.append(batch)
                continue
            same = np.logical_and.reduce([batch.column(i).to_numpy(zero_copy_only=False) == x for i, x in enumerate(last)])
            start = batch.num_rows - int(same.sum())
            done = [*held, batch.slice(0, start)]
            yield from found(pa.Table.from_batches(done))
            held = [batch.slice(start)]
        if held:
            yield from found(pa.Table.from_batches(held))

    key = c.select("class_id").schema
    placed = c.select("s", "class_id", "n").mapInArrow(place, type(key)().add("k", "integer").add("choice", "integer").add("key", "long").add(key["class_id"]).add("z", "long").add("n", "long").add("bits", "binary"))
    return placed.repartition("k", "choice", "key").sortWithinPartitions("k", "choice", "key").mapInArrow(meet, type(key)([key["class_id"]]).add("m", "long"))
