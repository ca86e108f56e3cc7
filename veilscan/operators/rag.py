"""Retrieval chunks: stuffing and hijacking against a query, directives that cannot be checked, claims of authority, coordinated sources."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import catalog as C
from veilscan.operators import scan
from veilscan.operators.components import connected_components
from veilscan.operators.scan import any_of, count_of
from veilscan.session import stage


def _words(text: Column) -> Column:
    """Maximal runs of anything but blanks, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"\S+"), F.lit(0))


def _hits(words: Column, asked: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.array_contains(asked, w)))


def _sentences(text: Column) -> Column:
    return F.transform(F.split(text, r"[.!?\n]+"), lambda s: F.regexp_replace(s, r"^\s+|\s+\z", ""))


def keyword_stuffing(chunks: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, n_words, hits, density, confidence) of chunks of ten words or more with ten or more of the query's words, above 0.15 of all.

    Null texts and null or blank queries give none; repeated chunks repeat.
    """
    rows = chunks.filter(F.col(text).isNotNull() & F.col(query).isNotNull()).select(F.col(key), _words(F.col(text)).alias("w"), F.array_distinct(_words(F.col(query))).alias("q"))
    rows = rows.select(key, F.size("w").cast("bigint").alias("n_words"), _hits(F.col("w"), F.col("q")).cast("bigint").alias("hits"))
    density = F.col("hits") / F.col("n_words")
    rows = rows.filter((F.col("n_words") >= 10) & (F.col("hits") >= 10)).withColumn("density", F.round(density, 6)).filter(density > 0.15)
    return rows.withColumn("confidence", F.round(F.least(F.lit(0.85), 0.5 + F.col("density")), 6))


def topic_hijacking(chunks: DataFrame, key: str, text: str, query: str) -> DataFrame:
    """(key, first_density, second_density) of chunks that begin with the query's words and turn to instructions without them.

    Sentences of more than ten characters count, four are needed; the second half must hold an instruction and less than half of the
    first half's share of query words, which is above 0.02. Null texts and null or blank queries give none.
    """
    rows = chunks.filter(F.col(text).isNotNull() & F.col(query).isNotNull()).select(F.col(key), F.filter(_sentences(F.col(text)), lambda s: F.length(s) > 10).alias("s"), F.array_distinct(_words(F.col(query))).alias("q"))
    rows = rows.filter(F.size("s") >= 4).withColumn("mid", F.floor(F.size("s") / 2).cast("int"))
    rows = rows.select(key, "q", F.array_join(F.slice("s", 1, F.col("mid")), " ").alias("a"), F.array_join(F.slice("s", F.col("mid") + 1, F.size("s")), " ").alias("b"))
    share = lambda c: _hits(_words(F.col(c)), F.col("q")) / F.greatest(F.size(_words(F.col(c))), F.lit(1))
    rows = rows.filter(any_of(F.col("b"), C.SMUGGLING) > 0).select(key, share("a").alias("x"), share("b").alias("y"))
    return rows.filter("x > 0.02 AND y < x * 0.5").select(key, F.round("x", 6).alias("first_density"), F.round("y", 6).alias("second_density"))


def opaque_directives(items: DataFrame) -> DataFrame:
    """(kind, id, regression, severity, confidence): a security change by reference to an artefact, without a word on what it does."""
    t = F.col("text")
    rows = items.filter("text IS NOT NULL AND length(text) >= 15").filter(t.rlike(C.EXECUTION) & t.rlike(C.ARTIFACT) & t.rlike(C.SECURITY) & ~t.rlike(C.DETAIL))
    back = t.rlike(C.REGRESSION)
    return rows.select("kind", "id", back.alias("regression"), F.when(back, 3).otherwise(2).alias("severity"), F.when(back, 0.8).otherwise(0.65).alias("confidence"))


def instruction_sentences(chunks: DataFrame, text: str, source: str) -> DataFrame:
    """(sentence, source) of every sentence of more than fifteen characters that gives an instruction, in lower case, each once.

    A sentence that matches lies in a text that matches, so other texts are not taken apart.
    """
    rows = scan.once(chunks.filter(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.coalesce(source, F.lit("unknown")).alias("source")), "low", F.lower("t"))
    rows = rows.filter(reduce(or_, (scan.may_match(F.col("low"), p) & F.col("t").rlike(p) for p in C.SMUGGLING)))
    rows = scan.once(rows.select("t", "source"), "sentences", F.filter(_sentences(F.col("t")), lambda s: F.length(s) > 15)).select(F.explode("sentences").alias("s"), "source")
    return rows.filter(reduce(or_, (F.col("s").rlike(p) for p in C.SMUGGLING))).select(F.lower("s").alias("sentence"), "source").distinct()


#: Up to so many words (of the shorter sentence) a pair meets on two words at once, longer ones on one: the keys grow with the square of the words.
_PAIRED = 40


def _keys(one: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(s, n, o, t, u) with a suffix a for the shorter and b for the longer sentence of a pair: where the rows (sid, w) meet; o is all words.

    Words are ordered from the rarest up. Of two sets of s <= l words more than ``least * (s + l) / (1 + least)`` are shared: more than
    ``2 * least / (1 + least) * s`` of the shorter one, more than ``least * l`` of the longer. So the first k shared words are among the shorter's
    first s - m + k and the longer's first l - m + k, m being the least number that is shared. They are the pair's key.
    """
    terms = one.select("sid", F.explode("w").alias("term"))
    counted = terms.join(terms.groupBy("term").agg(F.count("*").alias("df")), "term")
    ordered = counted.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("df", F.xxhash64("term").alias("h")))).alias("o"))
    ordered = ordered.select("sid", F.expr("transform(o, x -> x.h)").alias("o"), F.size("o").alias("n"))
    one_word = "transform(slice(o, 1, {0} + 1), x -> struct(x AS t, x AS u))"
    two_words = "flatten(transform(slice(o, 1, {0} + 1), (x, i) -> transform(slice(o, i + 2, greatest({0} + 1 - i, 0)), y -> struct(x AS t, y AS u))))"
    none = "cast(array() AS array<struct<t: bigint, u: bigint>>)"
    as_short, as_long = (f"(n - cast(floor({share} * n) AS int) - 1)" for share in (2 * least / (1 + least), least))
    short = f"CASE WHEN n <= {_PAIRED} THEN {two_words.format(as_short)} ELSE {one_word.format(as_short)} END"
    long = f"concat(CASE WHEN {least} * n <= {_PAIRED} THEN {two_words.format(as_long)} ELSE {none} END, CASE WHEN n > {_PAIRED} THEN {one_word.format(as_long)} ELSE {none} END)"
    keyed = lambda keys, x: ordered.select(F.col("sid").alias(f"s{x}"), F.col("n").alias(f"n{x}"), F.col("o").alias(f"o{x}"), F.explode(F.expr(keys)).alias("k")).select(f"s{x}", f"n{x}", f"o{x}", "k.t", "k.u")
    return keyed(short, "a"), keyed(long, "b")


def _alike(one: DataFrame, least: float) -> DataFrame:
    """(a, b) with a < b of the rows (sid, w) whose word sets overlap by more than ``least``; each pair once, where its first shared words are the key."""
    short, long = _keys(one, least)
    met = short.join(long, ["t", "u"]).filter((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("sa") < F.col("sb")))).filter(F.col("na") > least * F.col("nb"))
    met = met.select("sa", "sb", "na", "nb", "t", "u", F.explode(F.array(F.array_intersect("oa", "ob"))).alias("both"))
    common, second = F.size("both"), F.when(F.col("t") == F.col("u"), 1).otherwise(2)
    met = met.filter(common / (F.col("na") + F.col("nb") - common) > least).filter((F.try_element_at("both", F.lit(1)) == F.col("t")) & (F.try_element_at("both", second) == F.col("u")))
    return met.select(F.least("sa", "sb").alias("a"), F.greatest("sa", "sb").alias("b"))


def coordinated_poisoning(chunks: DataFrame, text: str, source: str, least: float = 0.6) -> DataFrame:
    """(sentence, group_key, n_sources, n_links): instructions that recur, much alike, in several sources.

    Two sentences are linked when their word sets overlap by more than ``least``. One row a sentence whose group (over links) spans two
    sources or more; equal sentences of two sources are one row and link. A missing source counts as ``unknown``; null texts give nothing;
    empty in, empty out.
    """
    said = stage(instruction_sentences(chunks, text, source), "rag-said").df
    one = stage(said.groupBy("sentence").agg(F.xxhash64("sentence").alias("sid"), F.array_distinct(_words(F.col("sentence"))).alias("w")), "rag-sentences").df
    links = stage(_alike(one.select("sid", "w"), least), "rag-links").df
    labels = connected_components(links, "a", "b", "rag-groups").df.withColumnRenamed("node", "sid")
    degree = links.select(F.col("a").alias("sid")).union(links.select("b")).groupBy("sid").agg(F.count("*").alias("n_links"))
    full = one.select("sid", "sentence").join(labels, "sid", "left").join(degree, "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    spans = full.select("sentence", "label").join(said, "sentence").groupBy("label").agg(F.countDistinct("source").alias("n_sources")).filter("n_sources >= 2")
    return full.join(spans, "label").select("sentence", F.col("label").alias("group_key"), "n_sources", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def authority_claims(items: DataFrame) -> DataFrame:
    """(kind, id, n_claims, n_fabricated, n_unverified, boosters, severity): cited authorities that are invented or unknown.

    Claims of five characters or more count once each. A known name or start vouches for a claim; a fabricated form counts even so. The item
    is reported for any suspicious claim, or for more than two boosting phrases per hundred of more than twenty words. Null texts give none.
    """
    t = F.col("text")
    claims = F.concat(*[F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in C.CITATIONS])
    claims = F.array_distinct(F.filter(F.transform(claims, lambda c: F.regexp_replace(c, r"^\s+|\s+\z", "")), lambda c: F.length(c) >= 5))
    rows = items.filter("text IS NOT NULL").select(
        "kind", "id", count_of(t, r"\S+").alias("n_words"), sum((count_of(t, p) for p in C.BOOSTERS), F.lit(0)).alias("boosters"), F.explode(F.array(claims)).alias("claims")
    )
    known = lambda c: F.lower(c).rlike("|".join(C.KNOWN_NAMES)) | F.lower(c).rlike(f"^(?:{'|'.join(C.KNOWN_STARTS)})")
    typed = lambda c: F.lower(c).rlike("|".join(w for name, ws in C.CLAIM_TYPES if name != "researcher" for w in ws))
    invented = lambda c: any_of(c, C.FABRICATED) > 0
    rows = rows.select(
        "kind", "id", "n_words", "boosters", F.size("claims").cast("bigint").alias("n_claims"), F.size(F.filter("claims", invented)).cast("bigint").alias("n_fabricated"),
        F.size(F.filter("claims", lambda c: ~invented(c) & ~known(c) & typed(c))).cast("bigint").alias("n_unverified"),
    )
    bad = F.col("n_fabricated") + F.col("n_unverified")
    dense = (F.col("n_words") > 20) & (F.col("boosters") * 100 > 2 * F.col("n_words"))
    return rows.filter((bad > 0) | dense).select("kind", "id", "n_claims", "n_fabricated", "n_unverified", F.col("boosters").cast("bigint").alias("boosters"), F.when(bad >= 3, 3).otherwise(2).alias("severity"))
