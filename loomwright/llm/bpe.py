"""Byte-level BPE over a corpus: every distinct word is encoded once.

1. Documents are taken in *packs* of bounded text.  A pack is exploded into
   pre-tokens with their positions, kept as columns: the pack's distinct words,
   split by word hash, and per position the word's number in the pack.
2. The distinct words of all packs meet in a shuffle by word hash; each task
   encodes a word the first time it sees it, so once in the whole corpus.
3. The ids go back to the packs that asked, are joined to the positions, and
   each document's ids are reassembled in order.  Decoding joins the
   token-byte table (bounded by the vocabulary) to the ids.

Rows of the shuffles are compressed blocks of words, not single words: a word
of every document moves once per pack.  No key has more rows than packs.

Defined cases: a null or empty text has no tokens, and the digests of nothing;
repeated rows and repeated or null doc_ids each get their own result row; a
text of any length is encoded whole.
"""

from __future__ import annotations

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
import zstandard

from . import core

PACK = 12 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII characters only, where the standard library is faster.
ASCII = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"""


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Words(dict):
    """word -> number, given at first sight."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


def _zip(*arrays) -> bytes:
    parts = [np.ascontiguousarray(a).tobytes() if isinstance(a, np.ndarray) else a for a in arrays]
    head = np.array([len(p) for p in parts], np.int64).tobytes()
    return len(parts).to_bytes(4, "little") + zstandard.ZstdCompressor(level=3).compress(head + b"".join(parts))


def _unzip(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    raw = zstandard.ZstdDecompressor().decompress(blob[4:])
    sizes = np.frombuffer(raw[: 8 * n], np.int64)
    at = 8 * n + np.concatenate(([0], np.cumsum(sizes)))
    return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def _planes(a: np.ndarray) -> bytes:
    """Little numbers by byte planes, which compress much better than in a row."""
    return np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _pack(ids: list, seqs: list, words: Words, parts: int):
    """(pack, part, block) rows of one pack; part -1 has the positions."""
    seq = np.concatenate([np.frombuffer(s, np.uint32) for s in seqs]) if seqs else np.zeros(0, np.uint32)
    lens = np.array([len(s) // 4 for s in seqs], np.uint32)
    texts = [w.encode() for w in words]
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    h = core.hashes(buf, end - size, end) if len(texts) else np.zeros(0, np.uint64)
    part = (h % np.uint64(parts)).astype(np.int64)
    seen = np.bincount(seq, minlength=len(texts))
    # Common words get small numbers: the positions compress better.
    rank = np.argsort(-seen, kind="stable")
    number = np.empty(len(texts), np.uint32)
    number[rank] = np.arange(len(texts), dtype=np.uint32)
    rows = [(-1, _zip(_planes(lens), _planes(number[seq]), np.array([i if i is not None else 0 for i in ids], np.int64), np.array([i is None for i in ids])))]
    for p, w in core.by_part(part):
        rows.append((p, _zip(_planes(number[w]), _planes(size[w]), b"".join([texts[i] for i in w.tolist()]))))
    key = hashlib.blake2b(b"".join(hashlib.blake2b(r).digest() for _, r in rows), digest_size=16).digest()
    return pa.RecordBatch.from_arrays([pa.array([key] * len(rows), pa.binary()), pa.array([p for p, _ in rows], pa.int32()), pa.array([r for _, r in rows], pa.binary())], names=["pack", "part", "block"])


def packs(parts: int, limit: int = PACK):
    def run(batches):
        import regex

        general, plain = regex.compile(PATTERN).findall, re.compile(ASCII).findall
        ids, seqs, words, used = [], [], Words(), 0
        for batch, _, off in core.chunks(batches):
            size = np.diff(off).tolist()
            for i, text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), size, strict=True):
                tokens = (plain if text.isascii() else general)(text) if text else []
                ids.append(i)
                seqs.append(np.fromiter(map(words.__getitem__, tokens), np.uint32, len(tokens)).tobytes())
                used += n
                if used > limit or len(ids) >= 65536:
                    yield _pack(ids, seqs, words, parts)
                    ids, seqs, words, used = [], [], Words(), 0
        if ids:
            yield _pack(ids, seqs, words, parts)

    return run


def encoder(path: str):
    """Word blocks in, id blocks out; every distinct word of the partition encoded once."""

    def run(batches):
        import tiktoken

        piece = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})._encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for pack, part, block in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if part < 0:
                    continue
                number, size, raw = _unzip(block)
                end = np.cumsum(_unplanes(size).astype(np.int64))
                coded = []
                for a, b in zip([0, *end[:-1].tolist()], end.tolist(), strict=True):
                    if (x := known.get(w := raw[a:b])) is None:
                        x = known[w] = np.array(piece(w), "<u4").tobytes()
                    coded.append(x)
                out.append((pack, _zip(number, _planes(np.array([len(x) // 4 for x in coded])), _planes(np.frombuffer(b"".join(coded), "<u4")))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([b for _, b in out], pa.binary())], names=["pack", "block"])

    return run


def _assembled(left: pa.Table, right: pa.Table):
    """For each pack's positions: (ids of documents, null flags, tokens per document, all token ids)."""
    numbers, lens, flat = [], [], []
    for block in right.column("block").to_pylist():
        n, size, ids = map(_unplanes, _unzip(block))
        numbers.append(n), lens.append(size), flat.append(ids)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.uint32)
    number, size, flat = cat(numbers), cat(lens).astype(np.int64), cat(flat)
    n = int(number.max()) + 1 if len(number) else 0
    start, count = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    start[number], count[number] = np.cumsum(size) - size, size
    for part, block in zip(left.column("part").to_pylist(), left.column("block").to_pylist(), strict=True):
        if part >= 0:
            continue
        words, seq, ids, null = _unzip(block)
        words, seq = _unplanes(words).astype(np.int64), _unplanes(seq)
        if len(seq) and (int(seq.max()) >= n or (count[seq] < 0).any()):
            raise RuntimeError("the words of a pack changed while it was encoded; its input isn't repeatable")
        c = count[seq]
        upto = np.concatenate(([0], np.cumsum(c)))
        at = np.concatenate(([0], np.cumsum(words)))
        yield np.frombuffer(ids, np.int64), np.frombuffer(null, bool), upto[at], flat[core.ragged(start[seq], c)]


def _coded(docs, path: str, each, schema: str):
    spark = docs.sparkSession
    parts = core.partitions(spark)
    packed = core.docs_of(docs).mapInArrow(core.lean(packs(parts)), "pack binary, part int, block binary").repartition(parts, "pack")
    ids = core.fence(packed).where("part >= 0").repartition(parts, "part").mapInArrow(core.lean(encoder(path)), "pack binary, block binary")
    return packed.groupBy("pack").cogroup(ids.groupBy("pack")).applyInArrow(core.lean(each), schema)


def _table(path: str) -> list[bytes]:
    r = ranks(path)
    table = [b""] * (max(r.values()) + 1)
    for k, v in r.items():
        table[v] = k
    return table


_tables: dict[str, list[bytes]] = {}


def _token_bytes(path: str) -> list[bytes]:
    if path not in _tables:
        _tables[path] = _table(path)
    return _tables[path]


def digests(docs, path: str):
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded bytes."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        table = _token_bytes(path).__getitem__
        out = ([], [], [], [])
        for ids, null, at, flat in _assembled(left, right):
            for i, no, a, b in zip(ids.tolist(), null.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                part = flat[a:b]
                for x, v in zip(out, (None if no else i, b - a, hashlib.sha256(part.tobytes()).hexdigest(), hashlib.sha256(b"".join(map(table, part.tolist()))).hexdigest()), strict=True):
                    x.append(v)
        return pa.table([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _coded(docs, path, each, SCHEMA)


def encode(docs, path: str):
    """doc_id and the document's token ids."""

    def each(left: pa.Table, right: pa.Table) -> pa.Table:
        out_id, out = [], []
        for ids, null, at, flat in _assembled(left, right):
            out_id += [None if no else i for i, no in zip(ids.tolist(), null.tolist(), strict=True)]
            out += [flat[a:b].astype(np.int32) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.table([pa.array(out_id, pa.int64()), pa.array(out, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return _coded(docs, path, each, "doc_id long, ids array<int>")


def decode(encoded, path: str):
    """doc_id and the decoded bytes of ``ids``; an id outside the vocabulary raises."""

    def run(batches):
        table = _token_bytes(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            if any(i is None or not 0 <= i < len(table) for x in ids if x for i in x):
                raise ValueError("an id isn't in the vocabulary")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(map(table.__getitem__, x or ())) for x in ids], pa.binary())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


QUERY = "op3_byte_bpe"


def query(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), core.tokenizer_path("byte_bpe_50k.tiktoken"))
