"""Arrow-batch text kernels: words, k-gram hashes, minima and exact set overlap, all in numpy over whole batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.session import stage

WORD = re.compile(r"[^\W_]+")
_MOST_CACHED = 2_000_000
U = np.uint64


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MOST_CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASHES = _WordHashes()
#: ASCII letters to lower case, digits as they are, all else to a space.
_PLAIN = bytes(ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(128)).ljust(256)


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits of the lower-cased text; none for a null."""
    return WORD.findall(text.lower()) if text else []


def _plain(text: str | None) -> bytes:
    """The text's words in UTF-8, and spaces."""
    if not text:
        return b""
    return text.encode().translate(_PLAIN) if text.isascii() else " ".join(WORD.findall(text.lower())).encode("utf-8", "surrogatepass")


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All words' 64-bit hashes, one text after the other, and the number of words of each text.

    Words are cut out of one buffer and numbered by Arrow, so that Python sees each different word of the batch once.
    """
    parts = [_plain(t) for t in texts]
    buffer = np.frombuffer(b" ".join([b"", *parts, b""]), np.uint8)
    inside = buffer != 32
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    sizes = np.diff(np.searchsorted(start, np.cumsum([1, *(len(x) + 1 for x in parts)])))
    if not len(start):
        return np.zeros(0, U), sizes
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(end - start)])
    found = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(buffer[inside])]).dictionary_encode()
    known = np.fromiter(map(_HASHES.__getitem__, found.dictionary.to_pylist()), U, len(found.dictionary))
    return known[found.indices.to_numpy()], sizes


def slices(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    """Short slices of Arrow batches, so that the arrays made from one stay small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (xor-shift, multiply), so that sums of word hashes spread evenly."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: list[np.ndarray] = [np.ones(1, U), np.ones(1, U)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse (mod 2**64), kept and doubled as needed."""
    while len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            step = U(pow(base, len(_POWERS[i]), 1 << 64))
            _POWERS[i] = np.concatenate([_POWERS[i], _POWERS[i] * step])
    return _POWERS


def kgrams(flat: np.ndarray, sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, position) of every run of k words that stays inside its text: a polynomial hash from running sums."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ok = np.flatnonzero(pos <= np.repeat(sizes - k, sizes))
    if not len(ok):
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    up, down = _powers(len(flat))
    sums = np.concatenate([np.zeros(1, U), np.cumsum(flat * up[: len(flat)], dtype=U)])
    return mix((sums[ok + k] - sums[ok]) * down[ok] + U(k)), row[ok], pos[ok]


def text_class(flat: np.ndarray, sizes: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 63-bit id per text that depends on its word sequence alone: equal for texts of equal words."""
    out = np.zeros(len(sizes), np.int64)
    at = 0
    for i, n in enumerate(sizes.tolist()):
        out[i] = xxhash.xxh3_64_intdigest(flat[at : at + n].tobytes(), seed=salt) >> 1
        at += n
    return out


def fresh_rows(ids: np.ndarray, done: set[int]) -> np.ndarray:
    """Which rows bring an id that the task has not had; ``done`` is kept, and emptied when it grows large."""
    if len(done) > 1_000_000:
        done.clear()
    fresh = np.zeros(len(ids), bool)
    for i, x in enumerate(ids.tolist()):
        if x not in done:
            done.add(x)
            fresh[i] = True
    return fresh


def distinct_sets(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes, ordered by row and hash.

    They are sorted by one number, the row and as much of the hash as fits beside it, and by both where that leaves a tie.
    """
    bits = U(max(1, int(row.max(initial=0)).bit_length()))
    key = (row.astype(U) << (U(64) - bits)) | (h >> bits)
    order = np.argsort(key)
    tied = key[order[1:]] == key[order[:-1]]
    if (tied & (h[order[1:]] != h[order[:-1]])).any():
        order = np.lexsort((h, row))
    h, row = h[order], row[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[keep], row[keep]


def jaccard(left: list[str | None], right: list[str | None], k: int = 3) -> np.ndarray:
    """Exact overlap (intersection by union) of the two texts' sets of k consecutive words, pair by pair.

    A text that stands in several pairs of the batch is read once.
    """
    n = len(left)
    number: dict[str | None, int] = {}
    at = [np.array([number.setdefault(t, len(number)) for t in side], np.int64) for side in (left, right)]
    h, row, _ = kgrams(*word_hashes(list(number)), k)
    h, row = distinct_sets(h, row)
    count = np.bincount(row, minlength=len(number))
    start = np.cumsum(count) - count
    keys = []
    for side in at:
        size = count[side]
        pair = np.repeat(np.arange(n), size)
        i = np.repeat(start[side], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        keys.append((mix(h[i] + mix(pair.astype(U))), pair))
    both = np.sort(np.concatenate([keys[0][0], keys[1][0]]))
    met = both[1:][both[1:] == both[:-1]]  # in both sets: a pair's own hashes are distinct on each side
    pair_of = keys[0][1][in_sorted(keys[0][0], met)]
    common = np.bincount(pair_of, minlength=n)
    union = count[at[0]] + count[at[1]] - common
    return np.where(union > 0, common / np.maximum(union, 1), 0.0)


def in_sorted(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def heavy_kgrams(rows: DataFrame, text: str, grams, share: float, least: int = 50) -> np.ndarray:
    """Hashes of word runs that stand in the texts at least ``share`` times per text, and ``least`` times; sorted.

    ``grams`` gives a batch's hashes. Each block of texts reports the hashes that reach ``share / 2`` of the block, with their
    counts; one that reaches ``share`` overall keeps at least half of it in the sums, which is the mark (so some rarer ones
    join). Every text is counted. A block reports at most 2 / share times its mean text length, and so does
    the result: the bound on what is broadcast.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = BlockCounter(share, least)
        for batch in slices(batches):
            yield from counter.add(grams(*word_hashes(batch.column(0).to_pylist())), batch.num_rows)
        yield from counter.close()

    counts = rows.select(text).mapInArrow(count, "h bigint, n bigint, texts bigint")
    return heavy_of(counts, share, least)


class BlockCounter:
    """Counts hashes block by block; reports (h, n, texts) rows, a block's texts on the row of hash 0."""

    def __init__(self, share: float, least: int = 50, block: int = 4_000_000):
        self.share, self.least, self.block = share, least, block
        self.held: list[np.ndarray] = []
        self.size = self.n = 0

    def add(self, hashes: np.ndarray, texts: int) -> list[pa.RecordBatch]:
        self.held.append(hashes)
        self.size, self.n = self.size + len(hashes), self.n + texts
        return self.close() if self.size > self.block else []

    def close(self) -> list[pa.RecordBatch]:
        if not self.size:
            return []
        h = np.sort(np.concatenate(self.held))
        first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        c = np.diff(np.r_[first, len(h)])
        big = np.flatnonzero(c >= max(2, min(self.least / 2, self.n * self.share / 2)))
        out = pa.RecordBatch.from_arrays(
            [pa.array(np.append(h[first[big]], U(0)).view(np.int64)), pa.array(np.append(c[big], 0)), pa.array(np.append(np.zeros(len(big), np.int64), self.n))], ["h", "n", "texts"]
        )
        self.held, self.size, self.n = [], 0, 0
        return [out]


def heavy_of(counts: DataFrame, share: float, least: int = 50) -> np.ndarray:
    """The common hashes, sorted, from the reports of all blocks."""
    sums = stage(counts.groupBy("h").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")), "heavy")
    total = sums.df.agg(F.sum("texts")).first()[0] or 0
    kept = sums.df.filter(F.col("n") >= max(least, total * share) / 2).select("h").toArrow().column(0).to_numpy()
    sums.drop()
    return np.sort(kept.astype(np.int64).view(U))
