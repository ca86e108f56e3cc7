"""Near-duplicate records with small edits, grouped: meet-in-the-middle ball hashing over set fingerprints.

A fingerprint is a tuple of TUPLE minima of the record's set of three consecutive words; there are TABLES of them. The
distance of two fingerprints is the number of elements in one but not in both (a replaced element counts 2), the
radius is 2. Every fingerprint emits all variants within half the radius, that is with one element dropped
(the variant with nothing dropped adds nothing: who shares it shares the others). Two fingerprints within the radius
therefore always meet in a variant: dropping the element in which they differ leaves the same tuple; equal ones meet in three.
Colliding pairs are deduplicated, and those that share MEET variants are verified exactly.

Common runs take part in every other minimum only, drawn by the run and the place, alike in all records; a variant of
common runs alone is left out, but for records that consist of common runs by half or more. With an overlap of 0.50 and no
common run the chance to share fewer than MEET variants is 0.0007; where 0.4 of each record are common runs that all are
shared, it is 0.04, and falls with the overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.kernels import U, fresh_rows, heavy_of, in_sorted, kgrams, mix, slices, text_class, word_hashes
from veilscan.llm.pairs import EXPAND, LEAST_WORDS, read_once, verified
from veilscan.operators.components import connected_components
from veilscan.session import Stage, stage

TABLES, TUPLE, SHINGLE = 14, 3, 3
#: Word runs that stand this often per record are common.
COMMON = 0.002
MEET = 2
#: Buckets of up to this many texts are paired at once; fuller ones as told at ``_rest_pairs``, in blocks of BLOCK texts.
FULL, BLOCK = 32, 1000
#: The low bits of a variant say which one of a text's variants it is.
PLACES = 128

#: Odd multipliers: each is a permutation of the (already mixed) 64-bit hashes, and its minimum a sample of the set.
_FACTORS = mix(np.arange(1, TABLES * TUPLE + 1, dtype=U)) | U(1)
_LAST = U(np.iinfo(np.uint64).max - 1)


def variants(flat: np.ndarray, sizes: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, variant) of the balls of half the radius around each text's fingerprints.

    A minimum's lowest bit says whether its run is rare. Half of a common run's values are put last, the others are doubled:
    it weighs half a rare one.
    """
    h, row, _ = kgrams(flat, sizes, SHINGLE)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    hot = np.flatnonzero(in_sorted(h, common))
    mostly = 2 * np.bincount(row[hot], minlength=len(sizes)) >= np.bincount(row, minlength=len(sizes))
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    rows, out, of = row[first], [], []
    for t in range(TABLES):
        least = []
        for j in range(TUPLE):
            v = (h * _FACTORS[t * TUPLE + j]) | U(1)
            common_v = v[hot]
            v[hot] = np.where(common_v >> U(63), _LAST, common_v << U(1)) & ~U(1)
            least.append(np.minimum.reduceat(v, first))
        for drop in range(TUPLE):
            place = t * TUPLE + drop
            v, rare = np.full(len(first), 1 + place, U), np.zeros(len(first), bool)
            for j in range(TUPLE):
                if j != drop:
                    v = mix(v * U(0x9E3779B97F4A7C15) + least[j])
                    rare |= (least[j] & U(1)) == 1
            take = rare | mostly[rows]
            out.append(((v[take] & ~U(PLACES - 1)) | U(place)).view(np.int64))
            of.append(rows[take])
    return np.concatenate(of), np.concatenate(out)


def _postings(rows: DataFrame, common: np.ndarray) -> DataFrame:
    spread = rows.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches):
            flat, sizes = word_hashes(batch.column(0).to_pylist())
            salt = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = text_class(flat, sizes) ^ (salt << 56)
            fresh = fresh_rows(ids, done) & (sizes >= LEAST_WORDS)
            row, v = variants(flat[np.repeat(fresh, sizes)], sizes[fresh], spread.value)
            yield pa.RecordBatch.from_arrays([pa.array(v ^ (salt[fresh][row] * PLACES)), pa.array(ids[fresh][row])], ["variant", "class_id"])

    return rows.mapInArrow(run, "variant bigint, class_id bigint")


def _buckets(postings: DataFrame, full: int, name: str) -> Stage:
    """Pairs (variant 0) of each bucket of up to ``full`` texts; members of fuller ones come back with their variant (a = b).

    A sorted partition is read once, front to back, and at most full members are held, whatever a bucket's size.
    """
    ordered = postings.repartition("variant").sortWithinPartitions("variant")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        now, size = None, 0
        a: list[int] = []
        b: list[int] = []
        v: list[int] = []

        def close() -> None:
            if size <= full:
                for i in range(1, len(held)):
                    a.extend(held[:i])
                    b.extend([held[i]] * i)
                    v.extend([0] * i)

        for batch in batches:
            var, cls = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if len(var):
                alone = np.r_[True, var[1:] != var[:-1]] & np.r_[var[1:] != var[:-1], True]
                alone[0] = alone[-1] = False
                keep = np.flatnonzero(~alone)
                for x, c in zip(var[keep].tolist(), cls[keep].tolist()):
                    if x != now:
                        close()
                        now, held, size = x, [c], 1
                    elif c not in held:
                        size += 1
                        if size <= full:
                            held.append(c)
                        else:
                            for m in (*held, c) if size == full + 1 else (c,):
                                a.append(m), b.append(m), v.append(x)
            if len(a) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.int64())], ["a", "b", "variant"])
                a, b, v = [], [], []
        close()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(v, pa.int64())], ["a", "b", "variant"])

    return stage(ordered.mapInArrow(run, "a bigint, b bigint, variant bigint"), name)


def _mixed_pairs(over: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``met`` that reach MEET when the fuller buckets in which both stand are counted as well."""
    held = over.groupBy("class_id").agg(F.collect_set("variant").alias("vs"))
    both = met.join(held.select(F.col("class_id").alias("a"), F.col("vs").alias("va")), "a").join(held.select(F.col("class_id").alias("b"), F.col("vs").alias("vb")), "b")
    return both.filter(F.col("n") + F.size(F.array_intersect("va", "vb")) >= MEET).select("a", "b")


def _star_pairs(over: DataFrame) -> DataFrame:
    """Each member of a fuller bucket with the bucket's least one."""
    least = over.groupBy("variant").agg(F.min("class_id").alias("a"))
    return over.join(least, "variant").select("a", F.col("class_id").alias("b"))


def _rest_pairs(over: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of fuller buckets that share MEET of them and are not in one group yet.

    Most members of a fuller bucket hang together by then, and need not meet each other. The rest, dealt into blocks, meet every
    member of their bucket, block by block: a task holds two blocks, and no member is left out, whatever the size.
    """
    held = over.groupBy("class_id").agg(F.collect_set("variant").alias("vs")).filter(F.size("vs") >= MEET)
    known = held.join(labels.select(F.col("node").alias("class_id"), "label"), "class_id", "left").withColumn("label", F.coalesce("label", "class_id"))
    rows = stage(known.select("class_id", "label", "vs", F.explode("vs").alias("variant")), "neardup-over").df
    sizes = rows.groupBy("variant", "label").agg(F.count("*").alias("n")).groupBy("variant").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    sizes = sizes.filter("n > n_main").select("variant", "main", F.ceil((F.col("n") - F.col("n_main")) / BLOCK).alias("kr"), F.ceil(F.col("n") / BLOCK).alias("kq"))
    rows = rows.join(sizes, "variant")
    place = lambda k, seed: F.expr(f"pmod(xxhash64(class_id, {seed}), {k})")
    every = lambda k: F.explode(F.expr(f"sequence(0L, {k} - 1)"))
    cols = ["variant", "class_id", "label", "vs"]
    rest = rows.filter("label <> main").withColumn("r", place("kr", 1)).select(*cols, F.lit(True).alias("rest"), "r", every("kq").alias("q"))
    each = rows.withColumn("q", place("kq", 2)).select(*cols, F.lit(False).alias("rest"), every("kr").alias("r"), "q")

    def meet(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        variant = group.column("variant")[0].as_py()
        vs = group.column("vs").combine_chunks()
        values = vs.flatten().to_numpy(zero_copy_only=False)
        member = np.repeat(np.arange(len(group)), np.diff(vs.offsets.to_numpy()))
        at = np.zeros((PLACES, len(group)), np.int64)
        at[values & (PLACES - 1), member] = values
        ours = group.column("rest").to_numpy(zero_copy_only=False)
        ids, label = group.column("class_id").to_numpy(), group.column("label").to_numpy()
        left, right = np.flatnonzero(ours), np.flatnonzero(~ours)
        n = np.zeros((len(left), len(right)), np.int16)
        before = np.zeros(n.shape, bool)
        for p in np.flatnonzero(at.any(1)).tolist():
            x, y = at[p, left], at[p, right]
            same = (x[:, None] == y[None, :]) & (x != 0)[:, None]
            n += same
            if p < variant & (PLACES - 1):
                before |= same  # the pair is found in an earlier bucket
        i, j = np.nonzero((n >= MEET) & ~before & (label[left][:, None] != label[right][None, :]))
        a, b = ids[left[i]], ids[right[j]]
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return rest.unionByName(each).groupBy("variant", "r", "q").applyInArrow(meet, "a bigint, b bigint")


def near_links(read: DataFrame, least: float = 0.5) -> Stage:
    """(a, b, overlap): links of classes of equal texts whose overlap is ``least`` or more, enough to tie each group together.

    Buckets of up to FULL texts give all their links; of fuller buckets each member is compared with the least one, and then
    every pair that is not in one group yet.
    """
    common = heavy_of(read.filter("h IS NOT NULL").select("h", "n", "texts"), COMMON)
    records = read.filter("h IS NULL")
    texts = records.groupBy("class_id").agg(F.min("text").alias("text"))
    buckets = _buckets(_postings(records.select("text", "coll"), common), FULL, "neardup-buckets")
    over = buckets.df.filter("variant <> 0").select("variant", F.col("a").alias("class_id")).distinct()
    met = buckets.df.filter("variant = 0").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("n"))
    found = met.filter(F.col("n") >= MEET).select("a", "b")
    fuller = not over.isEmpty()
    if fuller:
        over = stage(over, "neardup-full")
        found = found.union(_star_pairs(over.df)).union(_mixed_pairs(over.df, met.filter(F.col("n") < MEET)))
    pairs = stage(found.filter("a <> b").distinct(), "neardup-pairs")
    buckets.drop()
    links = stage(verified(pairs.df, texts, least, SHINGLE), "neardup-links")
    pairs.drop()
    if not fuller:
        return links
    labels = connected_components(links.df, "a", "b", "neardup-first")
    rest = stage(_rest_pairs(over.df, labels.df).distinct(), "neardup-rest")
    more = stage(links.df.union(verified(rest.df, texts, least, SHINGLE)), "neardup-all-links")
    for done in (over, labels, rest, links):
        done.drop()
    return more


def near_groups(records: DataFrame, least: float = 0.5) -> DataFrame:
    """One row per record: (coll, id, class_id, group_key) with a group's key equal for all its records.

    ``records`` has coll, id and text. Records of one collection are linked when their sets of three consecutive
    words overlap by ``least`` or more, and grouped directly or through others. A null id, a null or empty text and texts under ten
    words are left out; repeated rows count once; texts of equal words share a class and, with it, a group.
    Empty tables give no rows.
    """
    known = records.filter("id IS NOT NULL AND text IS NOT NULL").select(F.col("coll").cast("int").alias("coll"), F.col("id").cast("bigint").alias("id"), "text")
    runs = lambda flat, sizes: kgrams(flat, sizes, SHINGLE)[0]
    read = read_once(known, ["coll", "id"], runs, COMMON, "neardup-read", "coll", keep_text=True)
    links = near_links(read.df, least)
    labels = connected_components(links.df, "a", "b", "neardup-components")
    links.drop()
    members = read.df.filter("h IS NULL").select("coll", "id", "class_id").distinct()
    full = members.join(labels.df.select(F.col("node").alias("class_id"), "label"), "class_id", "left")
    return full.select("coll", "id", "class_id", F.coalesce("label", "class_id").alias("group_key"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """(coll, id_a, id_b) of records in one group.

    Of more than EXPAND exact copies the one with the least id stands for all: it is paired with each copy and with
    all else in the group; the copies' other pairs are left out. Records of different texts are paired however many a group
    has, block against block.
    """
    some = groups.select("coll", "id", "class_id", "group_key").distinct()
    some = some.join(some.groupBy("group_key").agg(F.count("*").alias("n")).filter("n > 1").select("group_key"), "group_key")
    copies = some.groupBy("class_id").agg(F.count("*").alias("copies"), F.min("id").alias("least_id"))
    some = some.join(copies, "class_id").withColumn("lead", (F.col("copies") <= EXPAND) | (F.col("id") == F.col("least_id")))
    lead = some.filter("lead").select("group_key", "coll", "id").distinct()
    blocks = lead.groupBy("group_key").agg(F.ceil(F.count("*") / EXPAND).alias("k"))
    dealt = lead.join(blocks, "group_key").withColumn("own", F.expr("pmod(xxhash64(id), k)")).withColumn("other", F.explode(F.expr("sequence(0L, k - 1)")))
    a = dealt.select("group_key", "coll", F.col("id").alias("id_a"), F.col("own").alias("x"), F.col("other").alias("y"))
    b = dealt.select("group_key", F.col("id").alias("id_b"), F.col("other").alias("x"), F.col("own").alias("y"))
    each = a.join(b, ["group_key", "x", "y"]).filter("id_a < id_b").select("coll", "id_a", "id_b")
    star = some.filter("NOT lead").select("coll", F.col("least_id").alias("id_a"), F.col("id").alias("id_b"))
    return each.union(star)
