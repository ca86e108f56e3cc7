"""Records of held-out splits that also stand, exactly or nearly, in the training split: winnowing fingerprints.

Every text, train and held-out alike, is a sequence of hashes of K consecutive words. Of every WINDOW neighbouring hashes the
least is kept, in one order for all texts (rare runs before common ones, then by hash), so that two texts with K + WINDOW - 1
= 8 words in a row in common keep a common one. That covers an overlap of one half: a replaced word takes three of the
three-word runs from each side, so that with J >= 0.5 the shared stretches are six runs (8 words) long on average
and the longest of a pair of 48 words or more is no shorter. In shorter texts an edit near the middle leaves less: they have,
besides or instead, kept runs of SHORT_K words of every SHORT_WINDOW (5 words in a row). Kept hashes are joined across the splits, counted by pair, and pairs are compared exactly.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.llm.kernels import U, distinct_sets, fresh_rows, heavy_of, in_sorted, kgrams, mix, slices, text_class, word_hashes, words
from veilscan.llm.kernels import jaccard as exact_overlap
from veilscan.llm.pairs import EXPAND, LEAST_WORDS, class_texts, read_once
from veilscan.session import stage

#: Spellings of the splits, by letters only.
TRAIN = ("train", "training", "trn", "tr", "learn")
VALIDATION = ("validation", "valid", "val", "dev", "devel", "development", "eval", "evaluation")
TEST = ("test", "testing", "tst", "holdout", "heldout")

#: Words of a run, and neighbouring runs of which one is kept.
K, WINDOW = 6, 3
SHORT_K, SHORT_WINDOW = 4, 2
#: Sets of three-word runs up to SHORT have the short runs, those above half of it the long ones: a pair of 0.5 has one kind in common.
SHORT = 48
#: Runs in at least this share of the texts are common: kept last, and asked only of texts that hold little else.
COMMON = 0.0005
#: A pair must share one kept run for every NEED_ONE_IN that its poorer text has, at least one and at most NEED_MASK.
NEED_ONE_IN, NEED_MASK = 8, 15
#: Shares of a common run's texts, so that no run's join is one task's work.
SALTS = 16


def split_of(split: Column) -> Column:
    """train, validation or test whatever the spelling; NULL for anything else."""
    s = F.regexp_replace(F.lower(split), r"[^a-z]", "")
    return F.when(s.isin(*TRAIN), "train").when(s.isin(*VALIDATION), "validation").when(s.isin(*TEST), "test")


def minima(h: np.ndarray, row: np.ndarray, hot: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each ``window`` neighbours of one row, common ones last; a row shorter than that has one."""
    n = len(h)
    if not n:
        return np.zeros(0, np.int64)
    order = (h >> U(1)) | (hot.astype(U) << U(63))
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    size = np.diff(np.r_[first, n])
    at = np.arange(n)
    left = np.repeat(first + size, size) - at
    least, where = order.copy(), at.copy()
    for d in range(1, min(window, n)):
        better = np.flatnonzero((order[d:] < least[:-d]) & (left[:-d] > d))
        least[better], where[better] = order[better + d], better + d
    kept = np.zeros(n, bool)
    kept[where[at <= np.repeat(first + np.maximum(size - window, 0), size)]] = True
    return np.flatnonzero(kept)


def _short(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which texts have short runs, and which long ones."""
    n = np.bincount(distinct_sets(*kgrams(flat, sizes, 3)[:2])[1], minlength=len(sizes))
    return n <= SHORT, 2 * n > SHORT


def runs(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of all runs from which some are kept."""
    short, _ = _short(flat, sizes)
    return np.concatenate([kgrams(flat, sizes, K)[0], kgrams(flat[np.repeat(short, sizes)], sizes[short], SHORT_K)[0]])


def _kept(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray, k: int, window: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h, row, _ = kgrams(flat[np.repeat(which, sizes)], sizes[which], k)
    hot = in_sorted(h, common)
    kept = minima(h, row, hot, window)
    mostly = 2 * np.bincount(row, hot, minlength=which.sum()) >= np.bincount(row, minlength=which.sum())
    kept = kept[~hot[kept] | mostly[row[kept]]]
    return h[kept], np.flatnonzero(which)[row[kept]]


def fingerprints(flat: np.ndarray, sizes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, fingerprint, common or not, how many of them a row's pairs must share).

    A text gives its common kept runs only if common runs are at least half of its runs: two texts that overlap by
    one half share rarer runs otherwise. Of a text with runs of both lengths the fewer say how many must be shared.
    """
    short, long = _short(flat, sizes)
    out, need = [], np.full(len(sizes), NEED_MASK)
    for which, k, window in ((short, SHORT_K, SHORT_WINDOW), (long, K, WINDOW)):
        fp, of = distinct_sets(*_kept(flat, sizes, which, k, window, common))
        out.append((of, fp))
        n = np.bincount(of, minlength=len(sizes)) // NEED_ONE_IN
        need = np.where(which, np.minimum(need, np.maximum(n, 1)), need)
    of, fp = np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])
    return of, fp, in_sorted(fp, common), need


def postings(rows: DataFrame, common, held: bool) -> DataFrame:
    """(fp, class_id) of every distinct text of a task; the lowest four bits of the class say how many runs its pairs must share.

    A common run's training texts are dealt to SALTS names of the run, and its held-out texts stand under each name.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches):
            flat, sizes = word_hashes(batch.column(0).to_pylist())
            ids = text_class(flat, sizes)
            fresh = fresh_rows(ids, done) & (sizes >= LEAST_WORDS)
            row, fp, hot, need = fingerprints(flat[np.repeat(fresh, sizes)], sizes[fresh], common.value)
            ids = (ids[fresh] & ~np.int64(NEED_MASK)) | need
            copies = np.where(hot, SALTS, 1) if held else np.ones(len(fp), np.int64)
            salt = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies) if held else np.where(hot, (ids[row] >> 4) % SALTS, 0)
            fp, row = np.repeat(fp, copies), np.repeat(row, copies)
            fp = np.where(salt > 0, mix(fp + salt.astype(U)), fp)
            yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(ids[row])], ["fp", "class_id"])

    return rows.select("text").mapInArrow(run, "fp bigint, class_id bigint")


def kept_places(texts: list[str]) -> list[dict[int, list[int]]]:
    """Where each text's kept runs stand."""
    h, row, pos = kgrams(*word_hashes(texts), K)
    kept = minima(h, row, np.zeros(len(h), bool))
    out: list[dict[int, list[int]]] = [{} for _ in texts]
    for fp, i, at in zip(h[kept].tolist(), row[kept].tolist(), pos[kept].tolist()):
        out[i].setdefault(fp, []).append(at)
    return out


def seeds(ours: dict[int, list[int]], theirs: dict[int, list[int]]) -> list[tuple[int, int]]:
    """Places of the kept runs of both texts; a run that recurs is matched first with first, second with second."""
    return [x for fp, at in ours.items() for x in zip(at, theirs.get(fp, ()))]


def aligned(left: list[str], right: list[str], starts: list[tuple[int, int]]) -> int:
    """Words of ``right`` covered by the heaviest chain of collinear seeds, each extended both ways while the words agree."""
    blocks = []
    end: dict[int, int] = {}  # of the last block of each diagonal
    for i, j in sorted(set(starts)):
        if i < end.get(i - j, 0):
            continue
        a, b = i, j
        while a and b and left[a - 1] == right[b - 1]:
            a, b = a - 1, b - 1
        n = 0
        while a + n < len(left) and b + n < len(right) and left[a + n] == right[b + n]:
            n += 1
        blocks.append((a, b, n))
        end[i - j] = a + n
    events = sorted([(a, 1, x) for x, (a, _, _) in enumerate(blocks)] + [(a + n, 0, x) for x, (a, _, n) in enumerate(blocks)])
    ends, weights = [0], [0]  # the frontier: the heaviest chain that ends in ``right`` at or before each place
    weight = [0] * len(blocks)
    for _, opens, x in events:
        _, b, n = blocks[x]
        if opens:
            weight[x] = n + weights[bisect_right(ends, b) - 1]
            continue
        at = bisect_right(ends, b + n)
        if weights[at - 1] < weight[x]:
            upto = at
            while upto < len(ends) and weights[upto] <= weight[x]:
                upto += 1
            ends[at:upto], weights[at:upto] = [b + n], [weight[x]]
    return weights[-1]


def class_overlaps(rows: DataFrame, common: np.ndarray, least: float = 0.5, shingle: int = 3) -> DataFrame:
    """(train_class, held_class, overlap, covered): pairs of distinct texts across the splits.

    Pairs that share enough kept runs are compared exactly. In a pair found the kept runs that both texts have are chained where
    they are collinear and extended by alignment (``covered`` = share of the held-out text's words).
    """
    spread = rows.sparkSession.sparkContext.broadcast(common)
    train = postings(rows.filter("side = 'train'"), spread, False).withColumnRenamed("class_id", "a")
    held = postings(rows.filter("side <> 'train'"), spread, True).withColumnRenamed("class_id", "b")
    met = train.join(held, "fp").groupBy("a", "b").agg(F.count("*").alias("shared"))
    met = met.filter(F.col("shared") >= F.least(F.col("a").bitwiseAND(NEED_MASK), F.col("b").bitwiseAND(NEED_MASK)))
    pairs = stage(met.select(F.col("a").bitwiseAND(~NEED_MASK).alias("a"), F.col("b").bitwiseAND(~NEED_MASK).alias("b")), "overlap-pairs").df
    class_of = F.col("class_id").bitwiseAND(~NEED_MASK)
    ta = class_texts(rows.filter("side = 'train'"), "text", class_of, "a").withColumnRenamed("text", "ta")
    tb = class_texts(rows.filter("side <> 'train'"), "text", class_of, "b").withColumnRenamed("text", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            left, right = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            share = exact_overlap(left, right, shingle)
            ok = np.flatnonzero(share >= least - 1e-12)
            texts = list({t: None for x in ok for t in (left[x], right[x])})
            known = {t: (words(t), places) for t, places in zip(texts, kept_places(texts))}
            covered = []
            for x in ok:
                (left_words, ours), (right_words, theirs) = known[left[x]], known[right[x]]
                covered.append(aligned(left_words, right_words, seeds(ours, theirs)) / len(right_words))
            at = pa.array(ok)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(share[ok]), pa.array(covered, pa.float64())], ["train_class", "held_class", "overlap", "covered"]
            )

    full = pairs.join(tb, "b").join(ta, "a").select("a", "b", "ta", "tb")
    return full.mapInArrow(run, "train_class bigint, held_class bigint, overlap double, covered double")


def overlap_stages(samples: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(links between classes of equal texts, deliveries: sample_id, source, side, n_words, class_id of each counted row)."""
    rows = samples.select("sample_id", "source", split_of(F.col("split")).alias("side"), "text")
    rows = rows.filter("sample_id IS NOT NULL AND text IS NOT NULL AND side IS NOT NULL")
    read = read_once(rows, ["sample_id", "source", "side"], runs, COMMON, "overlap-read")
    common = heavy_of(read.df.filter("h IS NOT NULL").select("h", "n", "texts"), COMMON)
    links = stage(class_overlaps(rows, common, least), "overlap-links").df
    return links, read.df.filter("h IS NULL").select("sample_id", "source", "side", "n_words", F.col("class_id").bitwiseAND(~NEED_MASK).alias("class_id"))


def class_members(deliveries: DataFrame) -> DataFrame:
    """(sample_id, class_id, held, side, source, n_words): repeated deliveries count once."""
    return deliveries.groupBy("sample_id", "class_id", (F.col("side") != "train").alias("held")).agg(
        F.min("side").alias("side"), F.min("source").alias("source"), F.min("n_words").alias("n_words")
    )


def cross_split_overlaps(samples: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per (train sample, held-out sample) whose sets of three consecutive words overlap by ``least`` or more.

    ``samples`` has sample_id, text, split, source and label; other columns are ignored. Rows without a known split, a
    null id, a null text or under ten words do not count; repeated deliveries count once. Texts of equal words are one
    class: a class of more than EXPAND copies on one side is given by its least sample against each sample of the
    other side, and the other side's least sample against each copy, so that no text and no row is lost (see also
    ``overlap_classes``, which has a row per class pair and membership). Empty tables give no rows.
    """
    links, deliveries = overlap_stages(samples, least)
    need = links.select(F.col("train_class").alias("class_id")).union(links.select(F.col("held_class"))).distinct()
    members = stage(class_members(deliveries.join(need, "class_id", "left_semi")), "overlap-members").df
    sizes = members.groupBy("class_id", "held").agg(F.count("*").alias("n"), F.min("sample_id").alias("least_id"))
    members = members.join(sizes, ["class_id", "held"]).withColumn("lead", (F.col("n") <= EXPAND) | (F.col("sample_id") == F.col("least_id")))
    t = members.filter("NOT held").select(F.col("class_id").alias("train_class"), F.col("sample_id").alias("train_id"), F.col("source").alias("train_source"), F.col("lead").alias("t_lead"), F.col("least_id").alias("t_least"))
    h = members.filter("held").select(F.col("class_id").alias("held_class"), F.col("sample_id").alias("held_id"), F.col("source").alias("held_source"), F.col("side").alias("held_split"), F.col("lead").alias("h_lead"), "least_id")
    led = links.join(t.filter("t_lead"), "train_class").join(h, "held_class").filter("t_lead AND (h_lead OR train_id = t_least)")
    rest = links.join(t.filter("NOT t_lead"), "train_class").join(h.filter("held_id = least_id"), "held_class")
    return led.unionByName(rest).filter("train_id <> held_id").select("train_id", "held_id", "held_split", "train_source", "held_source", "overlap", "covered")


def overlap_classes(samples: DataFrame, least: float = 0.5) -> DataFrame:
    """(sample_id, class_id, side, n_links): the class of every counted sample, and how many classes of the other side overlap with it."""
    links, deliveries = overlap_stages(samples, least)
    ends = links.select(F.col("train_class").alias("class_id"), F.lit(False).alias("held")).unionByName(links.select(F.col("held_class").alias("class_id"), F.lit(True).alias("held")))
    degree = ends.groupBy("class_id", "held").agg(F.count("*").alias("n_links"))
    return class_members(deliveries).join(degree, ["class_id", "held"], "left").select("sample_id", "class_id", "side", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def overlap_report(found: DataFrame) -> DataFrame:
    """Per held-out split and source: overlapping records, their pairs, mean coverage; spelling by letters and digits only."""
    key = F.regexp_replace(F.lower(F.coalesce("held_source", F.lit(""))), r"[^\p{L}\p{N}]", "")
    one = found.groupBy("held_split", key.alias("source"), "held_id").agg(F.count("*").alias("n"), F.max("covered").alias("covered"), F.max("overlap").alias("overlap"))
    return one.groupBy("held_split", "source").agg(
        F.count("*").alias("n_records"), F.sum("n").alias("n_pairs"), F.round(F.avg("covered"), 6).alias("mean_covered"), F.round(F.max("overlap"), 6).alias("max_overlap")
    )
