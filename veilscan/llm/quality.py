"""Text quality statistics per document, their exact per-language ranks, and the kind of text a document is."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.llm.kernels import WORD
from veilscan.operators.ordering import ranged, with_running_sum
from veilscan.session import stage

#: A kind must hold this share of the characters, in a document of at least so many words.
SHARE, LEAST_WORDS = 0.7, 25
STATS = ("n_words", "mean_word_length", "symbol_ratio", "punctuated_lines", "common_words")
#: Where prose-like lines are taken for garbled text.
OUTLIER, TAIL = 12.0, 0.02

#: Frequent function words of each language.
COMMON = {
    "en": "the a an and or but of to in on at by for with from as is are was were be been it its this that these those not no so than then when which who will would can could should before after into over under again we you they he she i our your their his her if because while there here has have had do does did",
    "de": "der die das den dem des ein eine einen einem einer und oder aber von zu in im an am auf bei für mit aus als ist sind war waren wird werden es dies diese dieser nicht kein so dann wenn welche ohne durch nach vor über unter wieder wir sie er ich nur noch zu erst seit danach hat haben bitte dass jeden",
    "fr": "le la les un une des et ou mais de du à au aux en sur par pour avec dans comme est sont était être il elle ce cette ces ne pas que qui si sans après avant sous nous vous ils je son sa ses leur plus depuis puis chaque encore on trop quand a seulement",
    "es": "el la los las un una unos unas y o pero de del a al en por para con como es son era ser lo este esta estos no que quien si sin tras antes bajo nosotros ellos yo su sus más desde luego cada todavía cuando solo sólo se conviene demasiado",
}
_COMMON = {k: frozenset(v.split()) for k, v in COMMON.items()}
_ANY_COMMON = frozenset().union(*_COMMON.values())

_HEADER = re.compile(r"(commit [0-9a-f]{7,}|From [0-9a-f]{7,}|Author:|AuthorDate:|Commit:|CommitDate:|Date:|Merge:|From:|Subject:|To:|Cc:|Message-Id:|---$)", re.I)
_DIFF = re.compile(r"(diff --git |diff -|index [0-9a-f]+\.\.|--- |\+\+\+ |@@ |Binary files |GIT binary patch|new file mode|deleted file mode|old mode|new mode|similarity index|rename (from|to) |copy (from|to) |\\ No newline)")
_AUTOMATIC = re.compile(r"(Merge (branch|remote|pull|tag|commit)|Signed-off-by:|Co-authored-by:|Reviewed-by:|Change-Id:|Translated using|Conflicts:|#\s|git-svn-id:|This reverts commit|Bump \S+ from )", re.I)
_BULLET = re.compile(r"(?:[-*+•·‣◦–—o]|\[[ xX*]?\])\s+\S")
_NUMBERED = re.compile(r"\(?(?:\d{1,4}|[a-z])[.)]\s+\S")
_PAIR = re.compile(r"[\w.\- /]{1,40}?\s*:\s+\S.{0,80}$")
_PATH_STATUS = re.compile(r"(modified|new file|deleted|renamed|added|copied|typechange|both modified):\s+\S+$")
_STAT = re.compile(r"\S+\s+\|\s+(\d+\s*[+-]*|Bin\b.*)$")
_RULE = re.compile(r"[|+:\-=─┼┬┴├┤┌┐└┘│╞╪╡ ]{3,}$")
_COLUMNS = re.compile(r"\t+|\s{2,}|\s*[|│;]\s*")
_HEXDUMP = re.compile(r"[0-9a-f]{6,}:?\s+(?:[0-9a-f]{2,4}\s+){4,}", re.I)
_LONG = re.compile(r"\S{38,}")
_ESCAPE = re.compile(r"\x1b\[|\\x[0-9a-f]{2}|\\u[0-9a-f]{4}|[�\x00-\x08\x0e-\x1f]", re.I)
_CODE = re.compile(r"[{}()\[\]=<>$&|^~`]|::|->|;\s*$|\w_\w*\.|^\s*(import|from|with|def|class|func|fn|let|const|var|return|raise|assert|if|for|while|static|export|#define|public|private|else|try|catch|switch|case|package|use|struct|type|enum|#include|//|/\*|#)\b")
_LATIN = re.compile(r"[a-zà-öø-ɏ]", re.I)
_VOWELS = re.compile(r"[aeiouyà-æè-ïò-öøù-üýÿāăąēĕėęěĩīĭįıōŏőœũūŭůűųŷ]", re.I)


def _is_letter(c: str) -> bool:
    """Letters of any script, with the marks that belong to them."""
    return c.isalpha() or (c > "\u02ff" and unicodedata.category(c)[0] == "M")


def common_share(words: list[str], lang: str) -> float:
    """Share of the words that are frequent function words of the language; where it is not known, of the one that fits best."""
    if not words:
        return 0.0
    lists = [_COMMON[lang]] if lang in _COMMON else _COMMON.values()
    return max(sum(w in known for w in words) for known in lists) / len(words)


def _is_junk(s: str) -> bool:
    """Encoded, minified or garbled: unbroken runs of mixed characters, hex dumps, broken encodings, letters without vowels."""
    n = len(s)
    if _HEXDUMP.match(s) or len(_ESCAPE.findall(s)) >= 2:
        return True
    solid = [x for x in _LONG.findall(s) if not x.startswith(("http://", "https://")) and x.count("/") < len(x) // 8 + 2 and x.count("-") + x.count("=") + x.count("*") < len(x) // 2]
    if solid and sum(map(len, solid)) >= 0.5 * n:
        return True
    letters = sum(c.isalpha() for c in s)
    odd = sum(1 for c in s if ord(c) > 126 and not _is_letter(c) or c in "ÃÂÐÑÅâï")
    if n >= 12 and odd >= 0.15 * n and not any(c in "│•·–—─┼" for c in s[:8]):
        return True
    if n >= 20:
        symbols = sum(1 for c in s if not c.isalnum() and not c.isspace())
        if symbols >= 0.45 * n and letters < 0.4 * n and not _RULE.match(s):
            return True
        if n >= 160 and symbols >= 0.22 * n and s.count(" ") < 0.04 * n:
            return True
        latin = len(_LATIN.findall(s))
        if latin >= 0.6 * n and len(WORD.findall(s)) >= 3 and len(_VOWELS.findall(s)) < 0.2 * latin:
            return True
    return False


def _columns(s: str) -> int:
    """Columns of a table row, 0 if it is none."""
    if s[0] in "|│" and s.count(s[0]) >= 3:
        return s.count(s[0]) - 1
    if _RULE.match(s) and any(c in s for c in "|─┼+│") and len(s) >= 5:
        return 2
    cells = [c for c in _COLUMNS.split(s.strip("|│ ")) if c]
    if len(cells) >= 3 and sum(len(c.split()) <= 2 for c in cells) >= 0.8 * len(cells):
        if sum(c.lower() in _ANY_COMMON for c in cells) >= 2:  # spaced-out sentences
            return 0
        if ";" in s and s.rstrip().endswith(";") or "  " in s and sum(len(c) for c in cells) > 90 and "\t" not in s:
            return 0
        return len(cells)
    if s.count(",") >= 2 and ", " not in s and "(" not in s:
        return s.count(",") + 1
    return 0


def line_kinds(text: str) -> tuple[dict[str, int], int]:
    """Characters of each kind ('text' is prose-like), and all characters, header block and blank lines apart."""
    lines = text.split("\n")
    at = 0
    while at < len(lines) and (_HEADER.match(lines[at]) or (at and not lines[at].strip() and at < 12)):
        at += 1
    chars = {"text": 0, "list": 0, "table": 0, "junk": 0, "other": 0}
    numbered = sum(1 for x in lines[at:] if _NUMBERED.match(x.lstrip("+ >\t")))
    in_diff = blob = False
    item_indent = -1
    for raw in lines[at:]:
        s = raw.strip()
        if not s:
            item_indent = -1 if not raw else item_indent
            continue
        n = len(s)
        kind = "other"
        if _DIFF.match(raw):
            in_diff, item_indent, blob = True, -1, raw.startswith("GIT binary")
            chars["other"] += n
            continue
        if blob and re.match(r"(literal|delta) \d+$", raw):
            chars["other"] += n
            continue
        body = raw
        if (in_diff and raw[0] in "+- ") or raw[0] == "+" or (raw[0] == "-" and raw[1:2] not in (" ", "-")):
            body = raw[1:]
        while body.lstrip().startswith(">"):
            body = body.lstrip()[1:]
        indent = len(body) - len(body.lstrip())
        b = body.strip()
        if not b:
            chars["other"] += n
            continue
        if _AUTOMATIC.match(b):
            kind = "other"
        elif not blob and (_STAT.match(b) or _columns(b) >= 3):
            kind = "table"
        elif blob or _is_junk(b):
            kind = "junk"
        elif _RULE.match(b):
            kind = "table" if "|" in b or "─" in b or "+" in b else "other"
        elif _BULLET.match(b) or (_NUMBERED.match(b) and numbered >= 3) or _PATH_STATUS.match(b):
            kind, item_indent = "list", indent
        elif item_indent >= 0 and indent > item_indent:
            kind = "list"
        elif _CODE.search(b) and not (b[-1] in ".,!?" and len(WORD.findall(b)) >= 5 and not re.search(r"[{}=;]|\w\(", b)):
            kind = "other"
        elif _PAIR.match(b) and len(b.split(":", 1)[0].split()) <= 2 and len(b.split(":", 1)[1].split()) <= 3:
            kind = "list"
        elif sum(_is_letter(c) or c.isspace() for c in b) >= 0.75 * len(b):
            kind = "text"
        if kind != "list":
            item_indent = -1
        chars[kind] += n
    return chars, sum(chars.values())


def language(lang):
    """Language key for ranks: lower case, und where missing."""
    key = F.lower(F.trim(F.coalesce(lang, F.lit(""))))
    return F.when(key == "", "und").otherwise(key)


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, the five statistics, shares of the kinds). A null text counts as empty: all zeros."""
    schema = "doc_id bigint, lang string, n_words bigint, mean_word_length double, symbol_ratio double, punctuated_lines double, common_words double, text_share double, list_share double, table_share double, junk_share double"
    names = [c.split()[0] for c in schema.split(", ")]

    def one(text: str | None, lang: str) -> tuple:
        text = text or ""
        words = WORD.findall(text.lower())
        lines = [x.rstrip() for x in text.split("\n") if x.strip()]
        solid = len(text) - sum(map(text.count, " \n\t\r"))
        letters = sum(map(len, words))
        chars, total = line_kinds(text)
        share = lambda k: round(chars[k] / total, 4) if total else 0.0
        return (
            len(words), round(letters / len(words), 4) if words else 0.0, round((solid - letters) / solid, 4) if solid else 0.0,
            round(sum(x[-1] in ".!?:;,…。" for x in lines) / len(lines), 4) if lines else 0.0,
            round(common_share(words, lang), 4), share("text"), share("list"), share("table"), share("junk"),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*[one(t, g) for t, g in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())])) or [[]] * (len(names) - 2)
            kinds = [pa.int64()] + [pa.float64()] * (len(names) - 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, t) for c, t in zip(cols, kinds)]], names)

    return docs.filter("doc_id IS NOT NULL").select("doc_id", language(F.col("lang")).alias("lang"), "text").mapInArrow(run, schema)


def rank_table(stats: DataFrame) -> DataFrame:
    """(stat, lang, value, low, high): exact shares of the language's documents at or below, and at or above, each value.

    Documents are counted by value before any shuffle; the distinct values are sorted by range partitions, and running
    counts get each partition's offset, so a language that holds most documents is spread over many tasks.
    """
    long = stats.select("lang", F.expr("stack(5, " + ", ".join(f"'{s}', cast({s} as double)" for s in STATS) + ") as (stat, value)"))
    counts = long.groupBy("stat", "lang", "value").agg(F.count("*").alias("n"))
    order = with_running_sum(ranged(counts, ["stat", "lang", "value"], "rank-order").df, F.col("n"), "upto", ["stat", "lang"])
    totals = order.groupBy("stat", "lang").agg(F.sum("n").alias("total"))
    full = order.join(totals, ["stat", "lang"])
    return full.select("stat", "lang", "value", (F.col("upto") / F.col("total")).alias("low"), ((F.col("total") - F.col("upto") + F.col("n")) / F.col("total")).alias("high"))


def text_quality(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, statistics, outlier_score, kind) of every document.

    Each statistic's tail probability is twice the smaller empirical-cumulative tail within the language, at most 1;
    the outlier score is minus the sum of their logarithms. ``kind`` is prose, list, table or junk if that kind of line
    makes up SHARE of the characters and the document has LEAST_WORDS words, else NULL. Lines that look like prose count as
    junk where the ranks say so: in a document whose outlier score exceeds OUTLIER while its share of common words is in the lowest
    TAIL of its language and its mean word length or its symbol ratio in the highest. Ranks need no word list, so prose
    in a language without one stays prose. Null and empty texts have zeros and no kind; empty in, empty out.
    """
    stats = stage(document_statistics(docs), "quality-stats").df
    ranks = stage(rank_table(stats), "quality-ranks").df
    out, score = stats, F.lit(0.0)
    for s in STATS:
        r = ranks.filter(F.col("stat") == s).select("lang", F.col("value").alias(f"v_{s}"), F.col("low").alias(f"low_{s}"), F.col("high").alias(f"high_{s}"))
        out = out.withColumn(f"v_{s}", F.col(s).cast("double")).join(r, ["lang", f"v_{s}"], "left")
        score = score - F.log(F.least(F.lit(1.0), 2 * F.least(f"low_{s}", f"high_{s}")))
    garbled = (score > OUTLIER) & (F.col("low_common_words") <= TAIL) & (F.least("high_mean_word_length", "high_symbol_ratio") <= TAIL)
    natural = ~F.coalesce(garbled, F.lit(False))
    prose = F.when(natural, F.col("text_share")).otherwise(0.0)
    junk = F.col("junk_share") + F.when(natural, 0.0).otherwise(F.col("text_share"))
    kind = F.when(F.col("n_words") < LEAST_WORDS, None).when(prose >= SHARE, "prose").when(F.col("list_share") >= SHARE, "list").when(F.col("table_share") >= SHARE, "table").when(junk >= SHARE, "junk")
    return out.select("doc_id", "lang", *STATS, F.round(score, 6).alias("outlier_score"), kind.alias("kind"), "text_share", "list_share", "table_share", "junk_share")
