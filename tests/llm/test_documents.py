"""Packing, leaks and text quality against brute force."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilscan.llm import leaks, packing, quality

WORD = re.compile(r"[^\W_]+")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_uses_every_item_once_and_never_overfills(sizes):
    counts = np.bincount(sizes, minlength=65) if sizes else np.zeros(65, np.int64)
    used = np.zeros(65, np.int64)
    n = 0
    for pattern, m in packing.plan_patterns(counts, 64):
        assert m > 0 and sum(pattern) <= 64
        n += m
        for s in pattern:
            used[s] += m
    assert (used[1:] == counts[1:]).all()
    assert n <= 2 * max(1, -(-sum(sizes) // 64))
    places, total = packing.slots(packing.plan_patterns(counts, 64))
    assert total == n and sum(hi - lo + 1 for _, lo, hi, _, _ in places) == len(sizes)


def test_plan_is_tight_and_its_size_does_not_follow_the_items():
    rng = np.random.default_rng(3)
    small = np.bincount(np.clip(rng.lognormal(5.8, 1.0, 5_000).astype(int), 1, 2048), minlength=2049)
    a, b = packing.plan_patterns(small, 2048), packing.plan_patterns(small * 1000, 2048)
    for plan, counts in ((a, small), (b, small * 1000)):
        tokens = (np.arange(2049) * counts).sum()
        assert tokens / (2048 * sum(m for _, m in plan)) > 0.98
    assert len(b) < 30_000


def test_pack_round_trip(spark):
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma delta", "x1"]) for _ in range(rng.choice((0, 3, 40, 200, 700, 3000)))), "c") for i in range(150)] + [(900, None, "c"), (901, "", "c"), (None, "lost", "c")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, container_id string")
    sizes = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    rows = packing.pack(df, 512).collect()
    filled, covered = {}, {}
    for r in rows:
        filled[r.container_id] = filled.get(r.container_id, 0) + r.n_tokens
        covered.setdefault(r.doc_id, []).append((r.first_token, r.n_tokens))
    assert max(filled.values()) <= 512 and set(covered) == set(sizes)
    for doc, parts in covered.items():
        at = 0
        for first, n in sorted(parts):
            assert first == at
            at += n
        assert at == sizes[doc] and (len(parts) == 1 or sizes[doc] > 512)
    report = packing.fill_report(packing.pack(df, 512), 512).first()
    assert report.n_tokens == sum(sizes.values()) and report.fill > 0.9
    assert packing.pack(df.limit(0)).count() == 0


def test_leaks_against_brute_force(spark):
    rng = random.Random(8)
    w = lambda n: [f"w{rng.randrange(60)}" for _ in range(n)]
    items = [(i, " ".join(w(rng.choice((5, 13, 20, 60))))) for i in range(40)] + [(100, ""), (101, None), (5, None), (102, "w1 w2")]
    items += [(200, items[1][1]), (1, items[1][1])]
    docs = []
    for i in range(200):
        body = w(rng.randrange(0, 120))
        if i % 3 == 0:
            src = (items[rng.randrange(40)][1] or "").split()
            n = rng.choice((12, 13, 14, 40))
            at = rng.randrange(max(1, len(src) - n + 1))
            pos = rng.randrange(len(body) + 1)
            body[pos:pos] = src[at : at + n]
        docs.append((i, "\n+ ".join(body).upper() if i % 2 else " ".join(body), "z"))
    docs += [(500, None, "z"), (501, "", "z")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, share string").repartition(5)
    e = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaks(d, e).filter("match = 'phrase'").collect()}
    grams = lambda t: {tuple(x[i : i + 13]) for x in [WORD.findall((t or "").lower())] for i in range(len(x) - 12)}
    item_grams = [(i, grams(t)) for i, t in items]
    want = {(doc, i) for doc, t, _ in docs for i, g in item_grams if g & grams(t)}
    assert got == want and len(want) > 20
    assert leaks.leaks(d.limit(0), e).count() == 0 and leaks.leaks(d, e.limit(0)).count() == 0
    index = leaks.build_index(d, segment=100)  # asked twice, once with other items
    again = {(r.doc_id, r.item_id) for r in leaks.leaks(d, e, index).filter("match = 'phrase'").collect()}
    some = {(r.doc_id, r.item_id) for r in leaks.leaks(d, e.filter("item_id % 2 = 0"), index).filter("match = 'phrase'").collect()}
    assert again == want and some == {x for x in want if x[1] % 2 == 0} and index.df.count() > 4


def test_proximity(spark):
    item = [f"w{i}" for i in range(30)]
    near = item[:10] + ["x"] + item[11:20] + ["y", "z"] + item[22:]
    d = spark.createDataFrame([(1, " ".join(near)), (2, " ".join(item[:10])), (3, " ".join(item[:7] + ["x"] + item[8:15]))], "doc_id bigint, text string")
    got = leaks.leaks(d, spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()
    assert [(r.doc_id, r.item_id, r.match, r.run_words) for r in got] == [(1, 7, "proximity", 10)] and got[0].share == pytest.approx(0.9)


def test_leaks_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 3)
    text = [" ".join(f"{c}{i}" for i in range(15)) for c in "abcdefg"]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id bigint, text string")
    e = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "item_id bigint, text string")
    assert {(r.doc_id, r.item_id) for r in leaks.leaks(d, e).collect()} == {(i, i) for i in range(7)}


PROSE = "The fallback for the parser stays open until the report has been checked. It is safe to move the listener here, since the other one never saw it.\n" * 4
HEADER = "commit 0123456789abcdef\nAuthor: a <a@b>\nDate:   2031-01-01\n\n"
CASES = {
    "prose": HEADER + PROSE, "quoted": HEADER + "".join("    > " + x + "\n" for x in PROSE.split(". ")), "list": HEADER + "".join(f"  - remove old thing {i}\n" for i in range(20)),
    "pairs": HEADER + "".join(f"    key_{i}: value{i}\n" for i in range(20)), "table": HEADER + "".join(f"| a{i} | {i}.5 | b{i} |\n" for i in range(20)), "csv": HEADER + "".join(f'+"{i}";"x{i}";"{i}.2"\n' for i in range(20)),
    "junk": HEADER + "".join("+ integrity sha512-" + "aB3dE5gH7j" * 8 + "==\n" for _ in range(20)), "code": HEADER + "diff --git a/x b/x\n@@ -1 +1 @@\n" + "".join(f"+    return foo_{i}(bar, {i})\n" for i in range(20)),
    "spaced": HEADER + PROSE.replace(" ", "  "), "short": "Fix it now", "merge": HEADER + "Merge branch 'a' into b\n" * 12,
}
KINDS = {"prose": "prose", "quoted": "prose", "list": "list", "pairs": "list", "table": "table", "csv": "table", "junk": "junk", "code": None, "spaced": "prose", "short": None, "merge": None}


def test_kinds_and_statistics(spark):
    docs = [(i, t, "en" if i % 2 else " EN ", "x") for i, t in enumerate(CASES.values())] + [(100, None, None, "x"), (101, "", "de", "x"), (None, "lost", "en", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, kind string")
    rows = {r.doc_id: r for r in quality.text_quality(df).collect()}
    assert {n: rows[i].kind for i, n in enumerate(CASES)} == KINDS
    assert len(rows) == len(CASES) + 2 and rows[100].n_words == 0 and rows[101].kind is None
    r = rows[0]
    w = WORD.findall(CASES["prose"].lower())
    assert r.n_words == len(w) and r.mean_word_length == pytest.approx(sum(map(len, w)) / len(w), abs=1e-4)
    assert quality.text_quality(df.limit(0)).count() == 0


OTHERS = {
    "ru": "Разбор входных данных теперь проверяется до записи в журнал. Это безопасно, потому что другая ветка его не видит.\n" * 5,
    "pl": "Obsługa pustych wierszy została przeniesiona do osobnej funkcji. Dzięki temu wynik nie zależy już od kolejności plików.\n" * 5,
    "it": "La lettura del registro resta aperta finché il controllo non è finito. Così nessuna riga viene persa durante la chiusura.\n" * 5,
    "hi": "यह परिवर्तन खाली पंक्तियों को पढ़ते समय होने वाली त्रुटि को ठीक करता है। अब परिणाम फ़ाइलों के क्रम पर निर्भर नहीं करता।\n" * 5,
}


def test_prose_without_a_word_list_is_prose(spark):
    docs = [(i, HEADER + t, g) for i, (g, t) in enumerate(OTHERS.items())] + [(50 + i, HEADER + PROSE + f"number {i}", "en") for i in range(20)]
    rows = quality.text_quality(spark.createDataFrame(docs, "doc_id bigint, text string, lang string")).collect()
    assert {r.kind for r in rows} == {"prose"}


def test_ranks_are_exact(spark):
    rng = random.Random(3)
    docs = [(i, " ".join("ab" for _ in range(rng.choice((1, 1, 1, 5, 9, 30)))), rng.choice(["en", "en", "en", "de"])) for i in range(300)]
    stats = quality.document_statistics(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    ranks = {(r.lang, r.value): (r.low, r.high) for r in quality.rank_table(stats).filter("stat = 'n_words'").collect()}
    n = {i: len(t.split()) for i, t, _ in docs}
    for lang in ("en", "de"):
        all_n = [n[i] for i, _, g in docs if g == lang]
        for v in set(all_n):
            assert ranks[lang, float(v)] == pytest.approx((sum(x <= v for x in all_n) / len(all_n), sum(x >= v for x in all_n) / len(all_n)))


def test_a_triple_of_short_lengths_is_found():
    counts = np.zeros(2049, np.int64)
    counts[np.setdiff1d(np.arange(400, 1001, 2), [698])] = 1  # even, so that no two or three of them fill an odd gap
    counts[1001], counts[349] = 1, 3
    assert ((1001, 349, 349, 349), 1) in packing.plan_patterns(counts, 2048)
