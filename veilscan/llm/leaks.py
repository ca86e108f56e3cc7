"""Held-out passages inside a training corpus: a stored positional inverted index, asked from the rarest terms.

The index is written once to the shared folder and can be asked again and again. It is made of segments: a segment holds whole documents of
about SEGMENT words, and lists, term by term, at which places each of their terms stands. No term is gathered anywhere,
so a term that stands in every document is spread like the documents are, and building needs no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.kernels import U, slices, word_hashes
from veilscan.session import Stage, stage

#: Consecutive words in common that make a leak, and the least run from which a proximity match is looked at.
PHRASE, NEAR_RUN, NEAR_SHARE = 13, 8, 0.6
#: Held-out items per pass over the index: the bound on what is broadcast (terms of one block).
BLOCK = 20_000
SEGMENT = 65_536
#: term: its sorted hashes; n: places of each; place: the places term by term, each but a term's first as the distance to the
#: one before; doc and first: the documents and their first places. Little-endian arrays of 8, 4, 4, 8 and 4 bytes.
INDEX = "term binary, n binary, place binary, doc binary, first binary"
MATCHES = "doc_id bigint, item_id bigint, match string, run_words int, share double"


def _segment(ids: list[int], flat: np.ndarray, sizes: np.ndarray) -> tuple[bytes, ...]:
    """One segment's row. A free place after each document keeps runs inside documents."""
    first = np.cumsum(sizes + 1) - sizes - 1
    at = np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(flat, kind="stable")
    terms, place = flat[order], at[order]
    start = np.flatnonzero(np.r_[True, terms[1:] != terms[:-1]]) if len(terms) else np.zeros(0, np.int64)
    gaps = np.diff(place, prepend=0)
    gaps[start] = place[start]
    arrays = ((terms[start], "<u8"), (np.diff(np.r_[start, len(terms)]), "<i4"), (gaps, "<i4"), (np.array(ids, np.int64), "<i8"), (np.r_[first, first[-1] + sizes[-1] + 1], "<i4"))
    return tuple(x.astype(kind).tobytes() for x, kind in arrays)


def build_index(docs: DataFrame, segment: int = SEGMENT) -> Stage:
    """Writes the index of (doc_id, text): one pass over the documents, each read once. Null ids and null or wordless texts are left out."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        flats: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        held = 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in _segment(ids, np.concatenate(flats), np.concatenate(sizes))], names)

        for batch in slices(batches, 50):
            flat, size = word_hashes(batch.column(1).to_pylist())
            some = size > 0
            ids += [i for i, s in zip(batch.column(0).to_pylist(), some.tolist()) if s]
            flats.append(flat)
            sizes.append(size[some])
            held += len(flat)
            if held >= segment:
                yield row()
                ids, flats, sizes, held = [], [], [], 0
        if held:
            yield row()

    known = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return stage(known.mapInArrow(run, INDEX), "leak-index")


class Items:
    """Held-out items as numbers of their terms; items of equal words are one."""

    def __init__(self, rows: list[tuple[int, str | None]]):
        by_words: dict[bytes, list[int]] = {}
        flat, sizes = word_hashes([t for _, t in rows])
        for (item_id, _), end, n in zip(rows, np.cumsum(sizes).tolist(), sizes.tolist()):
            if item_id is not None and n >= NEAR_RUN:
                by_words.setdefault(flat[end - n : end].tobytes(), []).append(item_id)
        self.ids = [sorted(set(v)) for v in by_words.values()]
        hashes = [np.frombuffer(w, U) for w in by_words]
        self.size = np.array([len(h) for h in hashes], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.terms, self.flat = np.unique(np.concatenate([*hashes, np.zeros(0, U)]), return_inverse=True)

    def choose_anchors(self, df: np.ndarray) -> None:
        """Of each NEAR_RUN neighbouring words the rarest in the corpus: every common run of that length holds one."""
        item, at = [], []
        for i, (start, n) in enumerate(zip(self.start.tolist(), self.size.tolist())):
            rare = df[self.flat[start : start + n]]
            spots = np.unique(np.arange(n - NEAR_RUN + 1) + np.lib.stride_tricks.sliding_window_view(rare, NEAR_RUN).argmin(1))
            item += [i] * len(spots)
            at += spots.tolist()
        self.anchor_item, self.anchor_at = np.array(item, np.int64), np.array(at, np.int64)
        self.anchor_term = self.flat[self.start[self.anchor_item] + self.anchor_at] if item else np.zeros(0, np.int64)


def _numbers(terms: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The number in ``terms`` (sorted) of each term asked for, -1 where there is none."""
    if not len(terms):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(terms, asked), len(terms) - 1)
    return np.where(terms[at] == asked, at, -1)


def term_frequencies(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Places in the whole corpus of each of the terms asked for: only the lists' lengths are read (as many sums as terms come back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(terms), np.int64)
        for batch in batches:
            for term, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = _numbers(np.frombuffer(term, "<u8"), terms)
                total[at >= 0] += np.frombuffer(n, "<i4")[at[at >= 0]]
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["term", "n"])

    df = np.zeros(len(terms), np.int64)
    got = index.select("term", "n").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return df


def match_segment(segment: tuple[bytes, ...], items: Items) -> list[tuple[int, int, int, float]]:
    """(doc_id, item, longest common run, share of the item's words in place) of each document and item.

    The anchors' lists, shifted by the anchors' places, give alignments; the lists of the neighbouring words, shifted alike, are
    intersected with them step by step, both ways, until the words no longer agree.
    """
    terms, n, gaps, docs, first = (np.frombuffer(x, kind) for x, kind in zip(segment, ("<u8", "<i4", "<i4", "<i8", "<i4")))
    number = _numbers(terms, items.terms)
    anchors = np.flatnonzero(number[items.anchor_term] >= 0)
    if not len(anchors):
        return []
    start = np.cumsum(n) - n
    place = np.cumsum(gaps, dtype=np.int64)
    place -= np.repeat(place[start] - gaps[start], n)  # each list begins anew
    posting = (np.repeat(np.arange(len(n)), n) << 32) | place  # sorted: by term, then by place
    of = number[items.anchor_term[anchors]]
    count = n[of].astype(np.int64)
    anchor = np.repeat(anchors, count)
    p = place[np.repeat(start[of], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)]
    item, q = items.anchor_item[anchor], items.anchor_at[anchor]
    item_start, size = items.start[item], items.size[item]

    def stands(term: np.ndarray, at: np.ndarray) -> np.ndarray:
        want = (number[term] << 32) | at
        return (number[term] >= 0) & (at >= 0) & (posting[np.minimum(np.searchsorted(posting, want), len(posting) - 1)] == want)

    def extend(step: int) -> np.ndarray:
        run = np.zeros(len(p), np.int64)
        live, d = np.arange(len(p)), 0
        while len(live):
            d += step
            live = live[(q[live] + d >= 0) & (q[live] + d < size[live])]
            live = live[stands(items.flat[item_start[live] + q[live] + d], p[live] + d)]
            run[live] += 1
        return run

    run = 1 + extend(1) + extend(-1)
    best: dict[tuple[int, int], tuple[int, float]] = {}
    keep = np.flatnonzero(run >= NEAR_RUN)
    for x, r in zip(keep.tolist(), (np.searchsorted(first, p[keep], "right") - 1).tolist()):
        i = int(item[x])
        at = np.arange(size[x]) + p[x] - q[x]
        inside = (at >= first[r]) & (at < first[r + 1])
        share = float((stands(items.flat[item_start[x] : item_start[x] + size[x]], at) & inside).sum() / size[x])
        old = best.get((r, i), (0, 0.0))
        best[r, i] = (max(old[0], int(run[x])), max(old[1], share))
    return [(int(docs[r]), i, n, share) for (r, i), (n, share) in best.items()]


def leaks(docs: DataFrame, held_out: DataFrame, index: Stage | None = None) -> DataFrame:
    """(doc_id, item_id, match, run_words, share): which documents carry which held-out items.

    ``match`` is 'phrase' for PHRASE or more consecutive words in common, else 'proximity' for a run of NEAR_RUN or more with
    at least NEAR_SHARE of the item's words in their places. ``index`` is one built before (``build_index``); otherwise the documents are
    indexed now. The items are the stated query set; they are asked in blocks of BLOCK, each against all segments. Null and empty
    texts match nothing; items of fewer than NEAR_RUN words match nothing; repeated items count once, and equal items each have
    their rows. Empty tables give no rows.
    """
    index = index or build_index(docs)
    asked = held_out.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("bigint").alias("item_id"), "text").distinct()
    blocks = max(1, -(-asked.count() // BLOCK))
    out = None
    for k in range(blocks):
        block = asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        items = Items([(r.item_id, r.text) for r in block.collect()])
        items.choose_anchors(term_frequencies(index.df, items.terms))
        spread = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], spread=spread) -> Iterator[pa.RecordBatch]:
            items = spread.value
            for batch in batches:
                for segment in zip(*(c.to_pylist() for c in batch.columns)):
                    rows = [(doc, i, n, s) for doc, j, n, s in match_segment(segment, items) if n >= PHRASE or s >= NEAR_SHARE for i in items.ids[j]]
                    cols = list(zip(*rows)) or [(), (), (), ()]
                    match = ["phrase" if n >= PHRASE else "proximity" for n in cols[2]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, kind) for x, kind in zip((cols[0], cols[1], match, cols[2], cols[3]), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64()))], [c.split()[0] for c in MATCHES.split(", ")]
                    )

        part = index.df.mapInArrow(run, MATCHES)
        out = part if out is None else out.unionByName(part)
    return out
