"""Hidden channels of text and what they carry: symbols to bits to bytes, in Column expressions over one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import catalog as C
from veilscan.operators.scan import beyond_ascii, count_of, once


def only(text: Column, characters: str) -> Column:
    """The characters of one class, all others dropped."""
    return F.regexp_replace(text, "[^" + characters[1:], "")


def bytes_of(bits: Column) -> Column:
    """Whole bytes of a string of 0 and 1, in hex; a rest of fewer than eight bits is dropped."""
    parts = F.regexp_extract_all(bits, F.lit("[01]{32}|[01]{8}"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.lpad(F.conv(x, 2, 16), F.floor(F.length(x) / 4).cast("int"), F.lit("0"))), "")


def readable(hexadecimal: Column) -> Column:
    """The bytes as text, if more than six tenths of two characters or more can be printed; else NULL."""
    text = F.make_valid_utf8(F.unhex(hexadecimal).cast("string"))
    printed = F.length(text) - F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}]"))
    return F.when((F.length(text) >= 2) & (printed > 0.6 * F.length(text)), text)


def _symbols(text: Column, kinds: Column) -> tuple[Column, Column]:
    """Number of kinds, and bits of a string of two kinds (one bit each) or three (two bits each), in the order given."""
    one = F.call_function("translate", text, F.array_join(kinds, ""), F.lit("01"))
    three = F.call_function("translate", text, F.array_join(kinds, ""), F.lit("abc"))
    two = F.replace(F.replace(F.replace(three, F.lit("a"), F.lit("00")), F.lit("b"), F.lit("01")), F.lit("c"), F.lit("10"))
    n = F.size(kinds)
    return n, F.when(n == 2, one).when(n == 3, two)


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: F.length(c) > 0)


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _translate(text: Column, origin: str, to: str) -> Column:
    return F.translate(text, origin, to)


def channels(items: DataFrame) -> DataFrame:
    """(kind, id, channel, n_symbols, payload_hex, payload, severity, confidence): every hidden channel of each item.

    zero_width: U+200C and U+200D as bits. tags: tag characters as the ASCII they mirror. spaces: two or three kinds of odd spaces, by code
    point. braille: a byte a cell. emoji: two kinds in balance, the first that occurs is 0. skin_tones: two bits a tone. trailing: blanks and
    tabs at line ends, on three lines of three or more and three tenths of all lines, or on eight lines of fewer with sixteen bits. nbsp: runs
    of blanks with a no-break space (1) or without (0). indents: two or four blanks. ``payload`` is the bytes as text where it reads
    as text. Null and empty texts have no channels; repeated rows repeat.
    """
    t = F.col("text")
    rows = once(items.filter("text IS NOT NULL").select("kind", "id", "text"), "beyond", beyond_ascii(t))
    b = F.col("beyond")
    trailing = F.transform(F.regexp_extract_all(t, F.lit(r"[ \t\r](?<![ \t\r]{2})[ \t\r]*+(?=\n|\z)"), F.lit(0)), lambda x: F.replace(x, F.lit("\r"), F.lit("")))
    indents = F.transform(F.regexp_extract_all(F.concat(F.lit("\n"), t), F.lit(r"\n( {2,8})(?=[^ \t\n\x0B\f\r])"), F.lit(1)), lambda x: F.length(x))
    blanks = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, "[^ \u00a0]+", "|"), " +", "0"), "0?\u00a0[0\u00a0]*", "1")
    tags = only(b, r"[\x{E0020}-\x{E007E}]")
    found = {
        "trailing": trailing, "indents": F.filter(indents, lambda n: n.isin(2, 4, 6, 8)), "n_lines": F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1,
        "nbsp_bits": F.when(b.contains("\u00a0"), F.replace(blanks, F.lit("|"), F.lit(""))).otherwise(""), "emoji": _characters(only(b, C.EMOJI)), "spaces": only(b, C.SPACES),
        "zero": _translate(only(b, "[\u200c\u200d]"), "\u200c\u200d", "01"), "tones": only(b, C.SKIN), "tag_text": _translate(tags, "".join(chr(c) for c in range(0xE0020, 0xE007F)), "".join(chr(c) for c in range(0x20, 0x7F))), "braille": only(b, C.BRAILLE),
    }
    rows = once(rows, "x", F.struct(*[c.alias(n) for n, c in found.items()])).select("kind", "id", "x.*")
    trailing, indents, emoji, spaces, tones, braille = (F.col(n) for n in ("trailing", "indents", "emoji", "spaces", "tones", "braille"))
    dense, sparse = F.size(F.filter(trailing, lambda x: F.length(x) >= 3)), F.size(F.filter(trailing, lambda x: F.length(x).between(1, 2)))
    kinds = F.array_distinct(emoji)
    n_first = F.size(F.filter(emoji, lambda c: c == F.try_element_at(kinds, F.lit(1))))
    _, space_bits = _symbols(spaces, F.array_sort(F.array_distinct(_characters(spaces))))
    tone_bits = tones
    for tone, bits in zip(C.TONES, C.TONE_BITS):
        tone_bits = F.replace(tone_bits, F.lit(tone), F.lit(bits))
    cells = _joined(F.transform(_characters(braille), lambda c: F.lpad(F.hex(F.ascii(c) - 0x2800), 2, "0")))
    bits = lambda parts, zero_at, one_at: _joined(F.transform(parts, lambda n: F.when(n.isin(*one_at), "1").otherwise("0")))
    ones = lambda parts, at: F.size(F.filter(parts, lambda n: n.isin(*at)))
    trail_bits = _translate(_joined(trailing), " \t", "01")
    shown = {
        "zero": F.col("zero"), "tags": F.lower(F.hex(F.encode(F.col("tag_text"), "UTF-8"))), "spaces": spaces, "space_bits": space_bits, "cells": F.lower(cells),
        "n_emoji": F.size(emoji), "n_emoji_kinds": F.size(kinds), "n_first": n_first, "emoji_bits": _joined(F.transform(emoji, lambda c: F.when(c == F.try_element_at(kinds, F.lit(1)), "0").otherwise("1"))),
        "tone_bits": tone_bits, "n_tones": F.length(tones), "dense": dense, "sparse": sparse, "n_lines": F.col("n_lines"), "trail_bits": trail_bits,
        "nbsp_bits": F.col("nbsp_bits"), "two": ones(indents, (2,)), "four": ones(indents, (4,)), "indent_bits": bits(indents, (2, 8), (4, 6)), "ones": ones(indents, (4, 6)),
    }
    rows = once(rows, "y", F.struct(*[c.alias(n) for n, c in shown.items()])).select("kind", "id", "y.*")
    size = lambda c: F.length(F.col(c))
    n_nbsp = count_of(F.col("nbsp_bits"), "1")
    balanced = (F.col("n_emoji") >= 8) & (F.col("n_emoji_kinds") == 2) & (F.col("n_first") > 0.2 * F.col("n_emoji")) & (F.col("n_first") < 0.8 * F.col("n_emoji"))
    is_dense = (F.col("dense") >= 3) & (F.col("dense") >= 0.3 * F.col("n_lines"))
    share = (F.col("dense") + F.col("sparse")) / F.col("n_lines")
    found = [
        (size("zero") >= 8, "zero_width", size("zero"), bytes_of(F.col("zero")), F.when(size("zero") > 20, 4).otherwise(3), F.lit(0.9)),
        (size("tags") > 0, "tags", size("tags") / 2, F.col("tags"), F.lit(4), F.lit(0.99)),
        (size("space_bits") >= 8, "spaces", size("spaces"), bytes_of(F.col("space_bits")), F.lit(3), F.lit(0.75)),
        (size("cells") > 0, "braille", size("cells") / 2, F.col("cells"), F.when(size("cells") > 20, 3).otherwise(2), F.lit(0.75)),
        (balanced, "emoji", F.col("n_emoji"), bytes_of(F.col("emoji_bits")), F.lit(3), F.lit(0.85)),
        (F.col("n_tones") >= 4, "skin_tones", F.col("n_tones"), bytes_of(F.col("tone_bits")), F.when(F.col("n_tones") > 8, 3).otherwise(2), F.when(F.col("n_tones") > 8, 0.7).otherwise(0.5)),
        (is_dense | ((F.col("sparse") >= 8) & (size("trail_bits") >= 16)), "trailing", size("trail_bits"), bytes_of(F.col("trail_bits")), F.when((size("trail_bits") > 40) | (F.col("dense") > 10), 3).otherwise(2), F.least(F.lit(0.9), 0.5 + 0.5 * share)),
        ((n_nbsp >= 3) & (size("nbsp_bits") - n_nbsp >= 3) & (size("nbsp_bits") >= 8), "nbsp", size("nbsp_bits"), bytes_of(F.col("nbsp_bits")), F.when(size("nbsp_bits") >= 16, 3).otherwise(2), F.when(size("nbsp_bits") >= 16, 0.8).otherwise(0.65)),
        ((F.col("two") >= 4) & (F.col("four") >= 4) & (size("indent_bits") >= 16) & (F.col("ones") >= 4) & (size("indent_bits") - F.col("ones") >= 4), "indents", size("indent_bits"), bytes_of(F.col("indent_bits")), F.when(size("indent_bits") >= 24, 3).otherwise(2), F.least(F.lit(0.88), 0.55 + 0.01 * size("indent_bits"))),
    ]
    hit = [F.when(when, F.struct(F.lit(name).alias("channel"), n.cast("bigint").alias("n_symbols"), F.lower(payload).alias("payload_hex"), severity.cast("int").alias("severity"), F.round(confidence.cast("double"), 4).alias("confidence"))) for when, name, n, payload, severity, confidence in found]
    rows = once(rows, "hits", F.array_compact(F.array(*hit))).select("kind", "id", F.explode("hits").alias("f"))
    return rows.select("kind", "id", "f.channel", "f.n_symbols", "f.payload_hex", readable(F.col("f.payload_hex")).alias("payload"), "f.severity", "f.confidence")


def acrostics(items: DataFrame) -> DataFrame:
    """(kind, id, letters, words, severity, confidence) of items whose sentences' first letters spell a word they must not.

    A sentence ends in ., ! or ? before blanks and a capital letter; those of two characters or fewer do not count, and six are needed. Words
    shorter than four letters are not looked for. Null texts give none.
    """
    marked = F.regexp_replace("text", r"([.!?])\s+([A-Z])", "$1\u0001$2")
    sentences = F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.regexp_replace(s, r"^\s+|\s+\z", "")), lambda s: F.length(s) > 2)
    rows = items.filter("text IS NOT NULL").select("kind", "id", F.explode(F.array(sentences)).alias("s")).filter(F.size("s") >= 6)
    rows = rows.select("kind", "id", _joined(F.transform("s", lambda s: F.lower(F.substring(s, 1, 1)))).alias("letters"))
    spelt = F.array_compact(F.array(*[F.when(F.col("letters").contains(w), w) for w in sorted(C.ACROSTIC_WORDS)]))
    rows = rows.select("kind", "id", "letters", F.explode(F.array(spelt)).alias("words")).filter(F.size("words") > 0)
    covered = F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)) / F.length("letters")
    confidence = F.least(F.lit(0.95), 0.5 + 0.5 * covered + 0.1 * F.size("words"))
    return rows.select("kind", "id", "letters", F.array_join("words", " ").alias("words"), F.when(F.size("words") >= 2, 3).otherwise(2).alias("severity"), F.round(confidence, 4).alias("confidence"))
