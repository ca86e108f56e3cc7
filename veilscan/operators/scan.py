"""Text items to findings, reports and clean copies: Column expressions only, one narrow stage until the roll-up."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import catalog as C
from veilscan.functions.literals import needed


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("bigint")


def beyond_ascii(text: Column) -> Column:
    """The text with each run of ASCII as one blank; empty where all is ASCII. Patterns of other characters alone match it as they match the text."""
    return F.when(F.octet_length(text) > F.length(text), F.regexp_replace(text, r"[\x00-\x7F]+", " ")).otherwise("")


#: Patterns of character classes without ASCII.
_BEYOND = re.compile(r"(?:(?:\[(?:\\x\{(?!0{0,6}[0-7]?[0-9A-Fa-f]\})[0-9A-Fa-f]+\}-?|[^\x00-\x7f]-?)+\]|\\x\{(?!0{0,6}[0-7]?[0-9A-Fa-f]\})[0-9A-Fa-f]+\})(?:\{\d+,\})?)+")


def any_of(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns match."""
    return sum((text.rlike(p).cast("int") for p in patterns), F.lit(0))


def may_match(low: Column, pattern: str) -> Column:
    """False only where the pattern cannot match the text of which this is the lower case: words that every match holds are missing."""
    return reduce(and_, (reduce(or_, (low.contains(w) for w in sorted(ws))) for ws in needed(pattern)), F.lit(True))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """``rows`` with one more column that is computed once a row: the optimizer copies no expression through a Generate."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def contains_of(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words occur."""
    return sum((text.contains(w).cast("int") for w in words), F.lit(0))


def detector_rows(items: DataFrame, d: C.Detector) -> DataFrame:
    """(kind, id, shown counts, severity, confidence) of the items on which one detector fires; null texts give none."""
    rows = items.filter("text IS NOT NULL").select("kind", "id", *[count_of(F.col("text"), p).alias(n) for n, p in d.counts.items()])
    return rows.filter(d.where).select("kind", "id", *d.shown, F.expr(f"CAST({d.severity} AS INT)").alias("severity"), F.expr(f"CAST(round(CAST({d.confidence} AS DOUBLE), 4) AS DOUBLE)").alias("confidence"))


def findings(items: DataFrame, detectors: list[C.Detector] | None = None) -> DataFrame:
    """(kind, id, seq, detector, method, severity, confidence): all detectors over one scan of the items, no shuffle."""
    rows = once(_with_findings(items.filter("text IS NOT NULL"), detectors), "all", F.col("found")).select("kind", "id", F.posexplode("all").alias("seq", "f"))
    return rows.select("kind", "id", "seq", "f.detector", "f.method", "f.severity", "f.confidence")


def _with_findings(rows: DataFrame, detectors: list[C.Detector] | None = None) -> DataFrame:
    """(kind, id, found): one row per item with the array of its findings."""
    detectors = C.DETECTORS if detectors is None else detectors
    rows = once(rows, "beyond", beyond_ascii(F.col("text")))
    counted = lambda d, p: count_of(F.col("beyond"), p) if _BEYOND.fullmatch(p) else F.when(F.col("beyond") != "", count_of(F.col("text"), p)).otherwise(F.lit(0).cast("bigint")) if d.wide else count_of(F.col("text"), p)
    rows = rows.withColumns({f"{d.name}__{n}": counted(d, p) for d in detectors for n, p in d.counts.items()}).drop("text", "beyond")
    found = []
    for d in detectors:
        names = sorted(d.counts, key=len, reverse=True)
        sql = lambda s, d=d, names=names: _rename(s, {n: f"{d.name}__{n}" for n in names})
        hit = F.struct(F.lit(d.name).alias("detector"), F.lit(d.method).alias("method"), F.expr(f"CAST({sql(d.severity)} AS INT)").alias("severity"), F.expr(f"CAST(round(CAST({sql(d.confidence)} AS DOUBLE), 4) AS DOUBLE)").alias("confidence"))
        found.append(F.when(F.expr(sql(d.where)), hit))
    return rows.select("kind", "id", F.array_compact(F.array(*found)).alias("found"))


def finding_details(items: DataFrame, detectors: list[C.Detector] | None = None) -> DataFrame:
    """``findings`` with what they rest on: (kind, id, detector, method, severity, confidence, description, evidence, location, metadata).

    The evidence is the code points of the first five matches, the location the place of the first (from 0), the metadata the
    detector's counts by name. Null texts give none.
    """
    detectors = C.DETECTORS if detectors is None else detectors
    t, hits = F.col("text"), []
    rows = items.filter("text IS NOT NULL").select("kind", "id", "text", F.octet_length("text").alias("_bytes"))
    wide = F.col("_bytes") > F.length("text")
    for d in detectors:
        counts = {n: count_of(t, p) for n, p in d.counts.items()}
        main = next(iter(d.counts.values()))
        points = F.transform(F.slice(F.regexp_extract_all(t, F.lit(main), F.lit(0)), 1, 5), lambda m: F.array_join(F.transform(F.filter(F.split(m, ""), lambda c: F.length(c) > 0), lambda c: F.concat(F.lit("U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))), " "))
        table = F.create_map(*[x for n, c in counts.items() for x in (F.lit(n), c)])
        hits.append((d, wide if d.wide else F.lit(True), F.struct(*[c.alias(n) for n, c in counts.items()], points.alias("points"), (F.instr(t, F.regexp_extract(t, main, 0)) - 1).alias("at"), table.alias("metadata"))))
    out = None
    for d, may, counted in hits:
        part = rows.filter(may).select("kind", "id", counted.alias("c")).select("kind", "id", "c.*").filter(d.where)
        part = part.select(
            "kind", "id", F.lit(d.name).alias("detector"), F.lit(d.method).alias("method"), F.expr(f"CAST({d.severity} AS INT)").alias("severity"), F.expr(f"CAST(round(CAST({d.confidence} AS DOUBLE), 4) AS DOUBLE)").alias("confidence"),
            F.concat(F.col(next(iter(d.counts))).cast("string"), F.lit(" of "), F.lit(d.method)).alias("description"), F.array_join("points", "; ").alias("evidence"), F.col("at").cast("bigint").alias("location"), "metadata",
        )
        out = part if out is None else out.unionAll(part)
    return out


def _rename(sql: str, names: dict[str, str]) -> str:
    return re.sub(r"\b[a-z_]+\b", lambda m: names.get(m[0], m[0]), sql)


def reports(items: DataFrame) -> DataFrame:
    """One report per item, clean items and null texts included: deliveries, findings of all of them, highest severity, flag.

    Findings are counted inside the row, so the one shuffle of a scan carries four numbers an item.
    """
    rows = _with_findings(items.withColumn("text", F.coalesce("text", F.lit("")))).select("kind", "id", F.explode(F.array("found")).alias("found"))  # the Generate keeps the patterns from being copied into both uses
    rows = rows.select("kind", "id", F.size("found").alias("n"), F.coalesce(F.array_max(F.transform("found", lambda f: f["severity"])), F.lit(0)).alias("top"))
    one = rows.groupBy("kind", "id").agg(F.count("*").alias("deliveries"), F.sum("n").alias("finding_count"), F.max("top").alias("highest_severity"))
    return one.withColumn("clean", F.col("finding_count") == 0)


def sanitized(text: Column) -> Column:
    """Invisible channels stripped, odd spaces to a space, look-alikes to Latin, at most two marks a letter."""
    out = text
    for p in (C.ZERO_WIDTH, C.INTERLINEAR, C.MONGOLIAN_VS, C.TAGS, C.VARIATION, C.BIDI, C.FILLERS):
        out = F.regexp_replace(out, p, "")
    out = F.regexp_replace(out, C.SPACES, " ")
    out = F.replace(F.translate(out, C.LOOKALIKE_FROM + C.FULLWIDTH_FROM, C.LOOKALIKE_TO + C.FULLWIDTH_TO), F.lit(C.ROMAN_TWO), F.lit("II"))
    return F.regexp_replace(out, f"({C.COMBINING}{{2}}){C.COMBINING}+", "$1")


def sanitized_aggressive(text: Column) -> Column:
    """``sanitized``, and mathematical letters to plain ones, braille and skin tones stripped, one mark a letter."""
    out = F.translate(sanitized(text), C.MATH_FROM, C.MATH_TO)
    for p in (C.MATH, C.BRAILLE, C.SKIN):
        out = F.regexp_replace(out, p, "")
    return F.regexp_replace(out, f"({C.COMBINING}){C.COMBINING}+", "$1")


def sanitized_layout(text: Column) -> Column:
    """Line ends to \\n, no blanks before them, at most one empty line in a row."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), r"[ \t\x0B\f]+\n", "\n")
    return F.regexp_replace(F.regexp_replace(lines, r"[ \t\x0B\f]+\z", ""), "\n{3,}", "\n\n")


def injection_categories(items: DataFrame, rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """(kind, id, category, severity) of each item: rules that match, and one more row of multi_vector at three categories.

    The matches pass through a Generate, so that the optimizer does not copy all patterns into each use of the array.
    """
    rules = C.RULES if rules is None else rules
    text = F.col("text")
    bare = F.regexp_replace(F.lower(text), "[^b-df-hj-np-tv-z]", "")
    skeleton = F.when(bare.rlike("|".join(C.SKELETONS)), "vowel_skeleton")
    hits = F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(p), c) for c, p in rules], skeleton)))
    rows = items.filter("text IS NOT NULL").select("kind", "id", F.explode(F.array(hits)).alias("hits")).filter(F.size("hits") > 0)
    hits = F.when(F.size("hits") >= 3, F.array_append("hits", F.lit("multi_vector"))).otherwise(F.col("hits"))
    severity = F.when(F.col("category").isin(*C.CRITICAL, "multi_vector"), 4).when(F.col("category").isin(*C.HIGH), 3).otherwise(2)
    return rows.select("kind", "id", F.explode(hits).alias("category")).withColumn("severity", severity)


def polarization(items: DataFrame) -> DataFrame:
    """(kind, id, words, superlatives, hedges, score) of items of thirty words or more."""
    rows = items.filter("text IS NOT NULL").select("kind", "id", count_of(F.col("text"), r"\S+").alias("n_words"), *[count_of(F.col("text"), p).alias(n) for n, p in (("superlatives", C.SUPERLATIVE), ("hedges", C.HEDGE), ("positive", C.POSITIVE), ("negative", C.NEGATIVE))])
    return rows.filter("n_words >= 30").select("kind", "id", "n_words", "superlatives", "hedges", F.expr(POLARIZATION_SQL).alias("score"))


POLARIZATION_SQL = (
    "round(least(1e0, superlatives * 100e0 / n_words / 4e0) * 0.35e0 + (1e0 - CASE WHEN superlatives + hedges > 0 THEN hedges * 1e0 / (superlatives + hedges) ELSE 0.5e0 END) * 0.25e0"
    " + (CASE WHEN positive + negative > 3 THEN greatest(positive, negative) * 1e0 / (positive + negative) ELSE 0e0 END) * 0.25e0 + least(1e0, superlatives / 6e0) * 0.15e0, 6)"
)
FRAMING_SQL = "round(least(urgency / 2e0, 1e0) * 0.3e0 + least(authority / 2e0, 1e0) * 0.25e0 + least((least(guilt, 1) + least(fear, 1) + least(flattery, 1) + least(sympathy, 1)) / 2e0, 1e0) * 0.25e0 + least(anchoring / 2e0, 1e0) * 0.1e0 + least(social / 2e0, 1e0) * 0.1e0, 6)"


def framing(items: DataFrame) -> DataFrame:
    """(kind, id, score > 0): weighted shares of urgency, authority, emotion, anchoring and social proof."""
    rows = items.filter("text IS NOT NULL AND length(text) >= 20").select("kind", "id", *[any_of(F.col("text"), ps).alias(n) for n, ps in C.FRAMING.items()])
    return rows.select("kind", "id", F.expr(FRAMING_SQL).alias("score")).filter("score > 0")


def chunk_poisoning(items: DataFrame) -> DataFrame:
    """(kind, id, smuggling, spoofing, contradiction, verdict) of retrieval chunks with any sign of poisoning."""
    t = F.col("text")
    rows = items.filter("text IS NOT NULL AND length(text) >= 15").select("kind", "id", any_of(t, C.SMUGGLING).alias("smuggling"), any_of(t, C.SPOOFING).alias("spoofing"), any_of(t, C.CONTRADICTION).alias("contradiction"))
    return rows.filter("smuggling > 0 OR spoofing >= 2 OR contradiction > 0").withColumn("severity", F.when(F.col("smuggling") > 0, 4).otherwise(3))


def repetition(items: DataFrame, least: int = 3) -> DataFrame:
    """(kind, id, repeats): the most often repeated sentence of an item, from ``least`` repeats on.

    Sentences are counted inside the row: no item's sentences meet another's, so nothing is shuffled.
    """
    parts = F.filter(F.transform(F.split(F.lower("text"), r"[.!?\n]+"), lambda s: F.trim(s)), lambda s: F.length(s) >= 10)
    rows = items.filter("text IS NOT NULL").select("kind", "id", F.array_sort(parts).alias("s"))
    runs = "aggregate(s, named_struct('last', '', 'run', 0, 'best', 0), (a, x) -> named_struct('last', x, 'run', if(x = a.last, a.run + 1, 1), 'best', greatest(a.best, if(x = a.last, a.run + 1, 1))), a -> a.best)"
    return rows.select("kind", "id", F.expr(runs).cast("bigint").alias("repeats")).filter(F.col("repeats") >= least)


def html_vectors(items: DataFrame) -> DataFrame:
    """(kind, id, vector, n, chars): hidden carriers in markup and how much text they hold."""
    rows = items.filter("text RLIKE '(?i)<|aria-|data-|content'")  # each of the patterns holds one of these
    found = [F.struct(F.lit(v).alias("vector"), F.size(F.regexp_extract_all("text", F.lit(p), F.lit(1))).cast("bigint").alias("n"), F.length(F.array_join(F.regexp_extract_all("text", F.lit(p), F.lit(1)), "")).cast("bigint").alias("chars")) for v, p in C.HTML_VECTORS.items()]
    return rows.select("kind", "id", F.explode(F.array(*found)).alias("f")).select("kind", "id", "f.vector", "f.n", "f.chars").filter("n > 0")


def heuristic_features(items: DataFrame) -> DataFrame:
    """Ten of the text features that a trap classifier is fed with, each between 0 and 1."""
    low = F.lower("text")
    return items.filter("text IS NOT NULL").select(
        "kind", "id",
        F.round(F.least(contains_of(low, C.KEYWORDS) / 5.0, F.lit(1.0)), 6).alias("keywords"),
        F.when((contains_of(low, C.CREDENTIALS) > 0) & (contains_of(low, C.CREDENTIAL_ACTIONS) > 0), 1.0).when(contains_of(low, C.CREDENTIALS) > 0, 0.5).otherwise(0.0).alias("credentials"),
        F.round(F.least(contains_of(low, C.URGENCY_WORDS) / 3.0, F.lit(1.0)), 6).alias("urgency"),
        F.when(contains_of(low, C.ROLE_WORDS) > 0, 1.0).otherwise(0.0).alias("role_hijack"),
        F.round(F.least(contains_of(low, C.TASK_WORDS) / 3.0, F.lit(1.0)), 6).alias("task_markers"),
        F.when(contains_of(low, C.AUTHORITY_WORDS) > 0, 1.0).otherwise(0.0).alias("authority"),
        F.round(count_of(F.col("text"), r"[^\p{L}\p{N}\s]") / F.greatest(F.length("text"), F.lit(1)), 6).alias("special_ratio"),
        F.when(F.length("text") < 50, 0.0).when(F.length("text") < 500, 0.5).otherwise(1.0).alias("length_bucket"),
        F.when(F.col("text").rlike(r'(?i)"(?:tool_call|function_call|tool_use|action|execute|command|cmd|shell|eval|run_sql)"'), 1.0).otherwise(0.0).alias("tool_call"),
        F.when(F.col("text").rlike(r"(?:FRAGMENT|CONTEXT_|PART_|SECTION_|CHUNK_)\d*"), 1.0).otherwise(0.0).alias("fragment_marker"),
    )


def rule_variants(items: DataFrame) -> DataFrame:
    """(kind, id, variant, category): every injection rule on the text as it is, without look-alikes, without leet and reversed."""
    plain = F.translate("text", C.LOOKALIKE_FROM + C.FULLWIDTH_FROM, C.LOOKALIKE_TO + C.FULLWIDTH_TO)
    forms = {"as_is": F.col("text"), "look_alikes": plain, "leet": F.translate(plain, C.LEET_FROM, C.LEET_TO), "reversed": F.reverse("text")}
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("variant"), t.alias("form")) for n, t in forms.items()])).alias("x")
    rows = items.filter("text IS NOT NULL").select("kind", "id", one).select("kind", "id", "x.variant", "x.form")
    hits = F.array_compact(F.array(*[F.when(F.col("form").rlike(p), c) for c, p in C.RULES]))
    return rows.select("kind", "id", "variant", F.explode(hits).alias("category")).distinct()
