"""Overlaps, near-duplicate groups and splits against brute force on small tables with every kind of dirt."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilscan.llm import kernels, neardup, overlaps, pairs, splits

WORD = re.compile(r"[^\W_]+")


def shingles(text, k=3):
    w = WORD.findall(text.lower()) if text else []
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= 10 else set()


def overlap(a, b):
    x, y = shingles(a), shingles(b)
    return len(x & y) / len(x | y) if x and y else 0.0


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        i = rng.randrange(len(words))
        words[i] = f"e{rng.randrange(10**6)}"
    return words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    out = []
    for i in range(120):
        n = rng.choice((12, 25, 60, 120, 400))
        base = [f"w{rng.randrange(3000)}" for _ in range(n)]
        out.append(" ".join(base))
        for _ in range(rng.randrange(3)):
            out.append(" ".join(edited(rng, base, rng.randrange(0, max(2, n // 14)))))
    out += ["", None, "short one", "a​b " * 30, "Ünïcode WÖRDS " * 9, "same text here for all of these copies to be one " * 2] + ["same text here, for all of these copies; to be one! " * 2] * 3
    return out


def test_kernel_overlap_is_exact(texts):
    left, right = texts, texts[1:] + texts[:1]
    got = kernels.jaccard(left, right)
    for a, b, g in zip(left, right, got):
        x = {tuple(w) for w in [WORD.findall((a or "").lower())[i : i + 3] for i in range(max(0, len(WORD.findall((a or "").lower())) - 2))]}
        y = {tuple(w) for w in [WORD.findall((b or "").lower())[i : i + 3] for i in range(max(0, len(WORD.findall((b or "").lower())) - 2))]}
        assert g == pytest.approx(len(x & y) / len(x | y) if x | y else 0.0)


def test_words_agree_with_the_definition(texts):
    flat, sizes = kernels.word_hashes(texts)
    assert sizes.tolist() == [len(WORD.findall((t or "").lower())) for t in texts]
    one, _ = kernels.word_hashes(["Abc déf"])
    two, _ = kernels.word_hashes(["abc"])
    assert one[0] == two[0]


def test_each_different_word_of_a_batch_is_hashed_once(texts, monkeypatch):
    asked = []

    class Known(dict):
        def __getitem__(self, word):
            asked.append(word)
            return xxhash.xxh3_64_intdigest(word)

    monkeypatch.setattr(kernels, "_HASHES", Known())
    odd = [*texts, "  ", "_", "x_y  z ", "\u0130stanbul \u00b2 \U0001d7d8a\x00b", "\ud800 lone", None, "last"]
    flat, sizes = kernels.word_hashes(odd)
    want = [w.encode("utf-8", "surrogatepass") for t in odd for w in WORD.findall((t or "").lower())]
    assert flat.tolist() == [xxhash.xxh3_64_intdigest(w) for w in want] and sizes.sum() == len(want)
    assert sorted(asked) == sorted(set(want)) and len(asked) < len(want)
    for none in ([], [None, ""]):
        flat, sizes = kernels.word_hashes(none)
        assert len(flat) == 0 and sizes.tolist() == [0] * len(none)


def test_distinct_sets_tell_hashes_apart_by_their_last_bits():
    rng = np.random.default_rng(5)
    row = np.sort(rng.integers(0, 900, 5000))
    h = rng.integers(0, 4, 5000).astype(kernels.U) << kernels.U(61) | rng.integers(0, 4, 5000).astype(kernels.U)
    got_h, got_row = kernels.distinct_sets(h, row)
    assert list(zip(got_row.tolist(), got_h.tolist())) == sorted({*zip(row.tolist(), h.tolist())})
    assert [len(x) for x in kernels.distinct_sets(h[:0], row[:0])] == [0, 0]


def test_kept_places_of_a_batch_are_those_of_each_text(texts):
    known = [t for t in texts if t]
    got = overlaps.kept_places(known)
    assert got == [overlaps.kept_places([t])[0] for t in known] and sum(map(bool, got)) > 100


def test_texts_of_pairs_are_shuffled_once(spark):
    rows = spark.createDataFrame([(f"w{i} " * 12,) for i in range(20)] * 2, "text string")
    pairs_of = spark.createDataFrame([(1, 2)], "a bigint, b bigint")
    one = pairs.class_texts(rows, "text", F.col("class_id").bitwiseAND(~15), "a")
    assert one.count() == 20 and one.columns == ["a", "text"]
    plan = pairs_of.join(one.hint("merge"), "a")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the pairs and the texts


def test_minima_cover_every_window():
    rng = np.random.default_rng(5)
    order, row = rng.integers(0, 2**60, 500).astype(np.uint64), np.sort(rng.integers(0, 30, 500))
    picked = set(overlaps.minima(order, row, rng.random(500) < 0.3, 4).tolist())
    for s in range(497):
        if row[s] == row[s + 3]:
            assert picked & set(range(s, s + 4))
    assert all(any(row[p] == r for p in picked) for r in set(row.tolist()))


def test_cross_split_overlaps(spark, texts):
    rng = random.Random(2)
    names = ["train", " Train", "TRAINING", "test", "Dev", "validation", None, "", "other"]
    rows = [(i, t, rng.choice(names), "src", 1, "x", 0) for i, t in enumerate(texts)] + [(3, texts[3], "train", None, None, "x", 0), (None, texts[0], "train", "s", 1, "x", 0)]
    df = spark.createDataFrame(rows, "sample_id bigint, text string, split string, source string, label int, class_id string, side int")
    got = {(min(r.train_id, r.held_id), max(r.train_id, r.held_id)) for r in overlaps.cross_split_overlaps(df).collect()}
    kind = lambda s: "t" if s and s.strip().lower().startswith("train") else "h" if s in ("test", "Dev", "validation") else None
    real = [(i, t, kind(s)) for i, t, s, *_ in rows if i is not None]
    want = {(min(a, b), max(a, b)) for a, x, p in real for b, y, q in real if p == "t" and q == "h" and a != b and overlap(x, y) >= 0.5}
    assert got == want and len(want) > 10
    report = overlaps.overlap_report(overlaps.cross_split_overlaps(df)).collect()
    assert sum(r.n_pairs for r in report) >= len(want)
    assert overlaps.cross_split_overlaps(df.limit(0)).count() == 0


def test_copies_beyond_the_limit_keep_every_row(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "EXPAND", 5)
    monkeypatch.setattr(neardup, "EXPAND", 5)
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(i, text, "train" if i < 20 else "test", "s") for i in range(40)]
    got = overlaps.cross_split_overlaps(spark.createDataFrame(rows, "sample_id bigint, text string, split string, source string")).collect()
    assert {r.train_id for r in got} == set(range(20)) and {r.held_id for r in got} == set(range(20, 40)) and len(got) < 60
    groups = neardup.near_groups(spark.createDataFrame([(0, i, text) for i in range(40)], "coll int, id bigint, text string"))
    assert {r.id_b for r in neardup.group_pairs(groups).collect()} == set(range(1, 40))


def groups_of(records):
    parent = {r: r for r, t in records if shingles(t)}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    items = [(r, t) for r, t in records if shingles(t)]
    for i, (a, x) in enumerate(items):
        for b, y in items[:i]:
            if a[0] == b[0] and overlap(x, y) >= 0.5:
                parent[top(a)] = top(b)
    out = {}
    for r in parent:
        out.setdefault(top(r), []).append(r)
    return {(a[0], a[1], b[1]) for v in out.values() for a in v for b in v if a[1] < b[1]}


def test_near_groups(spark, texts):
    records = [((0, i), t) for i, t in enumerate(texts)] + [((1, i), t) for i, t in enumerate(texts[::2])]
    df = spark.createDataFrame([(*r, t, 1) for r, t in records] + [(0, None, texts[0], 1), (0, 5, texts[5], 1)], "coll int, id bigint, text string, class_id int")
    got = {(r.coll, r.id_a, r.id_b) for r in neardup.group_pairs(neardup.near_groups(df)).collect()}
    want = groups_of(records)
    assert not got - want and len(got) >= 0.98 * len(want) > 50
    assert neardup.near_groups(df.limit(0)).count() == 0


def test_full_buckets_are_split(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FULL", 4)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(80)]
    rows = [(0, i, " ".join(edited(rng, base, 1))) for i in range(60)] + [(0, 100 + i, " ".join(f"z{rng.randrange(10**6)}" for _ in range(40))) for i in range(60)]
    got = neardup.near_groups(spark.createDataFrame(rows, "coll int, id bigint, text string")).collect()
    assert len({r.group_key for r in got if r.id < 60}) == 1 and len({r.group_key for r in got}) == 61


def test_ties_and_assignment(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        s = rng.choice(["hub"] * 5 + [f"src-{rng.randrange(300)}", "N/A", None, "real", "  "])
        a = rng.choice([f"au {rng.randrange(900)}", f"AU-{rng.randrange(900)}", "unknown", "-", None])
        c = "HUB" if rng.random() < 0.02 else "topic"
        rows.append((i, f"t{i}", rng.choice([0, 1, 1, None, -1]), c, s, a, "x"))
    rows += rows[:50]
    df = spark.createDataFrame(rows, "sample_id bigint, text string, label int, category string, source string, author string, node string")
    got = {r.sample_id: r.group_id for r in splits.tied_samples(df).collect()}
    key = lambda x: (lambda k: None if k in splits.STAND_INS else k)("".join(WORD.findall((x or "").lower())))
    known = {key(r[4]) for r in rows}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for i, _, _, c, s, a, _ in rows:
        s = key(s) or (key(c) if key(c) in known else None)
        for e in (("s", s), ("a", key(a))):
            if e[1]:
                parent[top(("r", i))] = top(e)
        top(("r", i))
    sets = {}
    for i in range(3000):
        sets.setdefault(top(("r", i)), []).append(i)
    assert got == {i: min(v) for v in sets.values() if len(v) > 1 for i in v}
    assert splits.tied_samples(df.limit(0)).count() == 0


def test_assignment_is_even_and_keeps_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1]), "t", f"s{rng.randrange(900)}", None) for i in range(6000)]
    out = splits.assign_splits(spark.createDataFrame(rows, "sample_id bigint, label int, category string, source string, author string")).toPandas()
    assert len(out) == 6000 and out.groupby("group_id").split.nunique().max() == 1
    share = out.split.value_counts(normalize=True)
    assert abs(share["train"] - 0.8) < 0.02 and abs(share["test"] - 0.1) < 0.02
    label = {r[0]: r[1] for r in rows}
    out["y"] = out.sample_id.map(label)
    assert out.groupby("split").y.mean().std() < 0.05
    empty = splits.assign_splits(spark.createDataFrame([], "sample_id bigint, label int, category string, source string, author string"))
    assert empty.count() == 0


def test_constants():
    assert pairs.LEAST_WORDS == 10 and abs(sum(splits.PROPORTIONS.values()) - 1) < 1e-9


def met_pairs(rng, n_common, n_shared, n_own, common):
    """Share of text pairs of true overlap n_shared / (n_shared + 2 n_own) that share MEET variants; n_common of the shared runs are common."""
    found, trials = 0, 300
    for _ in range(trials):
        shared = [f"b{i}" for i in range(n_common + 2)] + [f"s{rng.randrange(10**9)}" for _ in range(n_shared - n_common)]
        two = [" ".join(shared + [f"o{rng.randrange(10**9)}" for _ in range(n_own)]) for _ in range(2)]
        row, v = neardup.variants(*kernels.word_hashes(two), common)
        found += len(set(v[row == 0].tolist()) & set(v[row == 1].tolist())) >= neardup.MEET
    return found / trials


def test_common_runs_do_not_cost_recall():
    rng = random.Random(3)
    common = np.sort(kernels.kgrams(*kernels.word_hashes([" ".join(f"b{i}" for i in range(47))]), 3)[0])
    for n_common in (0, 30, 45):
        assert met_pairs(rng, n_common, 66, 34, common) > 0.95


def test_full_buckets_are_paired_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "FULL", 4)
    monkeypatch.setattr(neardup, "BLOCK", 16, raising=False)
    rng = random.Random(8)
    template = [f"t{i}" for i in range(45)]
    texts = []
    for _ in range(40):  # many small groups, all on one template
        own = [f"w{rng.randrange(10**6)}" for _ in range(45)]
        texts += [" ".join(template + edited(rng, own, 1)) for _ in range(3)]
    base = [f"f{i}" for i in range(80)]
    texts += [" ".join(edited(rng, base, 1)) for _ in range(60)]
    got = neardup.near_groups(spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "coll int, id bigint, text string")).collect()
    assert len({r.group_key for r in got}) == 41


def test_large_groups_of_different_texts_are_paired_whole(spark, monkeypatch):
    monkeypatch.setattr(neardup, "EXPAND", 5)
    rows = [(0, i, i, 1) for i in range(23)] + [(0, 100 + i, 99, 1) for i in range(12)]
    df = spark.createDataFrame(rows, "coll int, id bigint, class_id bigint, group_key bigint")
    got = [(r.id_a, r.id_b) for r in neardup.group_pairs(df).collect()]
    lead = [*range(23), 100]
    want = {(a, b) for a in lead for b in lead if a < b} | {(100, 100 + i) for i in range(1, 12)}
    assert set(got) == want and len(got) == len(want)


def test_overlaps_without_long_common_runs(spark):
    rng = random.Random(6)
    rows = []
    for every in (9, 10, 11, 13):  # one changed word in so many
        base = [f"w{rng.randrange(10**6)}" for _ in range(180)]
        rows.append((base, [f"x{rng.randrange(10**6)}" if i % every == every - 1 else w for i, w in enumerate(base)]))
    lines = [[f"l{rng.randrange(10**6)}" for _ in range(8)] for _ in range(24)]
    rows.append((sum(lines, []), sum(lines[::-1], [])))
    short = [f"s{rng.randrange(10**6)}" for _ in range(30)]
    rows += [(short, short * 3), (short * 3, short)]
    data = [(10 * i + j, " ".join(t), ("train", "test")[j], "s") for i, two in enumerate(rows) for j, t in enumerate(two)]
    want = {(x[0], y[0]) for x in data for y in data if x[2] == "train" and y[2] == "test" and overlap(x[1], y[1]) >= 0.5}
    got = overlaps.cross_split_overlaps(spark.createDataFrame(data, "sample_id bigint, text string, split string, source string")).collect()
    assert {(r.train_id, r.held_id) for r in got} == want and len(want) >= 7
    assert all(0 < r.covered <= 1 for r in got)


def test_all_ties_of_a_redelivered_sample_count(spark):
    rows = [(0, 1, "t", f"s{i}", None) for i in range(100)] + [(i + 1, 1, "t", f"s{i}", None) for i in range(100)]
    df = spark.createDataFrame(rows, "sample_id bigint, label int, category string, source string, author string")
    assert {(r.sample_id, r.group_id) for r in splits.tied_samples(df).collect()} == {(i, 0) for i in range(101)}


def recall(spark, rows):
    """Share of the true pairs that are found; rows are (id, text, split)."""
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "sample_id bigint, text string, split string, source string")
    got = {(r.train_id, r.held_id) for r in overlaps.cross_split_overlaps(df).collect()}
    sets = {i: shingles(t) for i, t, _ in rows}
    want = {(a, b) for a, _, s in rows for b, _, z in rows if s == "train" and z == "test" and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]) > 0}
    assert not got - want
    return len(got & want) / len(want), len(want)


def test_evenly_spaced_edits_at_the_least_overlap(spark):
    rng = random.Random(12)
    rows = []
    for i in range(150):
        n = rng.choice((40, 80, 200))
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        every = rng.choice((9, 10, 11))
        kind = i % 3
        if kind == 0:  # replaced words
            other = [f"x{rng.randrange(10**6)}" if k % every == every - 1 else w for k, w in enumerate(base)]
        elif kind == 1:  # inserted words
            other = [x for k, w in enumerate(base) for x in ((w, f"y{rng.randrange(10**6)}") if k % every == 0 else (w,))]
        else:  # lines of seven words in another order
            lines = [base[k : k + 7] for k in range(0, n, 7)]
            other = sum(sorted(lines), [])
        rows += [(2 * i, " ".join(base), "train"), (2 * i + 1, " ".join(other), "test")]
    share, n = recall(spark, rows)
    assert n >= 140 and share >= 0.97


def test_classes_have_all_links(spark, monkeypatch):
    monkeypatch.setattr(overlaps, "COMMON", 0.2)  # the template's runs are common: dealt to salted names
    rng = random.Random(14)
    template = [f"t{i}" for i in range(60)]
    rows = [(i, " ".join(template + [f"o{rng.randrange(10**6)}" for _ in range(20)]), "train" if i % 2 else "test") for i in range(160)]
    df = spark.createDataFrame([(i, t, s, "x") for i, t, s in rows], "sample_id bigint, text string, split string, source string")
    assert {r.n_links for r in overlaps.overlap_classes(df).collect()} == {80}
    assert overlaps.overlap_classes(df.limit(0)).count() == 0


def test_the_heaviest_collinear_chain_covers():
    left, right = "a b c d e f g h".split(), "e f g h x a b c".split()
    assert overlaps.aligned(left, right, [(0, 5), (4, 0)]) == 4
    assert overlaps.aligned(left, left, [(0, 0), (3, 3), (5, 5)]) == 8 and overlaps.aligned(left, right, []) == 0


def test_families_of_one_template(spark):
    """Groups of two in a large collection on one base text: links between families are many, true ones few."""
    rng = random.Random(15)
    base = [f"b{i}" for i in range(100)]
    texts = []
    for _ in range(300):
        one = [f"f{rng.randrange(10**6)}" if rng.random() < 0.25 else w for w in base]
        texts += [" ".join(one), " ".join(edited(rng, one, 2))]
    got = neardup.near_groups(spark.createDataFrame([(0, i, t) for i, t in enumerate(texts)], "coll int, id bigint, text string"))
    found = {(r.coll, r.id_a, r.id_b) for r in neardup.group_pairs(got).collect()}
    want = groups_of([((0, i), t) for i, t in enumerate(texts)])
    assert not found - want and len(found) >= 0.98 * len(want) > 250
