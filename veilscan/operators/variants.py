"""Plain readings of disguised text: each is a Column, tried by the injection rules beside the text itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import catalog as C
from veilscan.functions.literals import needed
from veilscan.operators.scan import may_match, once

# Cyrillic letters and the Latin ones they sound like.
PHONETIC_FROM, PHONETIC_TO = "абвгдезийклмнопрстуфх", "abvgdeziyklmnoprstufh"


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0))


def char_spaced(text: Column) -> Column:
    """``i g n o r e`` as one word: of eight tokens or more at least three quarters are single characters; else NULL."""
    tokens = _tokens(text)
    single = F.size(F.filter(tokens, lambda w: F.length(w) == 1))
    return F.when((F.size(tokens) >= 8) & (single >= 0.75 * F.size(tokens)), F.array_join(tokens, ""))


def token_boundaries(text: Column) -> Column:
    """Words joined by three underscores or more, or by dots between letters, taken apart; runs of blanks to one blank."""
    joined = r"\b[A-Za-z][A-Za-z0-9]*(?:_[A-Za-z0-9]+){3,}\b"
    apart = F.when(~text.contains("_"), text).otherwise(F.aggregate(F.array_distinct(F.regexp_extract_all(text, F.lit(joined), F.lit(0))), text, lambda out, w: F.replace(out, w, F.translate(w, "_", " "))))
    dots = F.regexp_replace(F.replace(apart, F.lit("\x00"), F.lit(" ")), r"(?<=[A-Za-z])\.(?=[A-Za-z])", " ")
    return F.regexp_replace(F.regexp_replace(dots, r"\s+", " "), r"^ | \z", "")


def pig_latin(text: Column) -> Column:
    """Words in -way lose it; of words in -ay the last letter before it goes to the front; end marks stay."""

    def one(w: Column) -> Column:
        core, marks = F.regexp_extract(w, r"^(.*?)[.,;:!?]*\z", 1), F.regexp_extract(w, r"([.,;:!?]*)\z", 1)
        n = F.length(core)
        way = F.concat(F.left(core, n - 3), marks)
        ay = F.concat(F.substring(core, n - 2, F.lit(1)), F.left(core, n - 3), marks)
        return F.when(~w.rlike(r"(?i)ay[.,;:!?]*\z"), w).when(core.rlike("(?i)way$") & (n > 3), way).when(core.rlike("(?i)ay$") & (n > 2), ay).otherwise(w)

    return F.array_join(F.transform(_tokens(text), one), " ")


def nato(text: Column) -> Column:
    """Spelling-alphabet words as their letters, other words as blanks: from eight words, seven tenths of them in the alphabet; else NULL."""
    table = F.create_map(*[F.lit(x) for pair in C.NATO.items() for x in pair])
    words = F.regexp_extract_all(text, F.lit("[A-Za-z]+"), F.lit(0))
    letters = F.transform(words, lambda w: F.try_element_at(table, F.lower(w)))
    hits = F.size(F.array_compact(letters))
    some = F.arrays_overlap(F.split(F.lower(text), "[^a-z]+"), F.array(*map(F.lit, C.NATO)))  # the map is asked word by word
    return F.when(some & (hits >= 8) & (hits >= 0.7 * F.size(letters)), F.array_join(F.transform(letters, lambda c: F.coalesce(c, F.lit(" "))), ""))


def full_width(text: Column) -> Column:
    """All of U+FF01 to U+FF5E as ASCII, the ideographic space as a blank."""
    return F.translate(text, "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000", "".join(map(chr, range(0x21, 0x7F))) + " ")


def plain_readings(text: Column) -> dict[str, Column]:
    """Every reading by name; NULL where the text is not so disguised."""
    wide = F.octet_length(text) > F.length(text)
    latin = F.replace(F.translate(text, C.LOOKALIKE_FROM + C.FULLWIDTH_FROM, C.LOOKALIKE_TO + C.FULLWIDTH_TO), F.lit(C.ROMAN_TWO), F.lit("II"))
    latin = F.when(wide, latin).otherwise(text)
    return {
        "as_is": text, "look_alikes": latin, "full_width": F.when(wide, full_width(text)).otherwise(text), "leet": F.translate(latin, C.LEET_FROM, C.LEET_TO), "phonetic": F.when(wide, F.translate(F.lower(text), PHONETIC_FROM, PHONETIC_TO)).otherwise(F.lower(text)), "reversed": F.reverse(text),
        "words_reversed": F.array_join(F.reverse(_tokens(text)), " "), "char_spaced": char_spaced(text), "token_boundaries": token_boundaries(text), "pig_latin": F.when(text.rlike(r"(?i)ay\b"), pig_latin(text)), "nato": nato(text),
        "bare": F.when(wide, F.regexp_replace(text, r"[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]|" + C.TAGS, "")).otherwise(text),
    }


def injected_readings(items: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(kind, id, reading, category): every injection rule on every reading that differs from the text, and on the text itself, each once.

    Null texts give none; repeated items count once. Readings, lower case and matches are each computed once (``once``), and a rule is tried
    only where the words are that it needs. Rules blind to case find in the lower case of ASCII what they find in it: one trial stands for both.
    """
    rules, t = rules or C.RULES, F.col("text")
    readings = plain_readings(t)
    rows = once(items.filter("text IS NOT NULL").select("kind", "id", "text"), "r", F.struct(*[c.alias(n) for n, c in readings.items()]))
    ascii_only = F.octet_length("text") == F.length("text") if all(_caseless(p) for _, p in rules) else F.lit(False)
    differs = lambda n: F.col(f"r.{n}").isNotNull() & (F.col(f"r.{n}") != t)
    shown = [F.when(differs(n) & (~ascii_only if n == "phonetic" else F.lit(True)), F.struct(F.array(F.lit(n)).alias("readings"), F.col(f"r.{n}").alias("form"))) for n in readings if n != "as_is"]
    as_is = F.struct(F.when(ascii_only & differs("phonetic"), F.array(F.lit("as_is"), F.lit("phonetic"))).otherwise(F.array(F.lit("as_is"))).alias("readings"), t.alias("form"))
    rows = once(rows, "forms", F.array_compact(F.array(as_is, *shown))).select("kind", "id", F.explode("forms").alias("x")).select("kind", "id", "x.readings", "x.form")
    rows = once(rows, "low", F.lower("form"))
    rows = once(rows, "hits", F.array_compact(F.array(*[F.when(may_match(F.col("low"), p) & F.col("form").rlike(p), c) for c, p in rules])))
    return rows.select("kind", "id", "readings", F.explode("hits").alias("category")).select("kind", "id", F.explode("readings").alias("reading"), "category").distinct()


def _caseless(pattern: str) -> bool:
    """Blind to the case of ASCII, or without a match in ASCII."""
    return pattern.startswith("(?i") or any(not any(w.isascii() for w in ws) for ws in needed(pattern))
