"""Queries over whole tables for the scanning operators, each with its SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilscan.functions import catalog as C
from veilscan.ml import classifier
from veilscan.operators import decode, guards, scan, structure
from veilscan.session import spread, stage, table

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
ORACLES: dict[str, str] = {}

ITEMS_SQL = "WITH items AS (SELECT 'sample' AS kind, sample_id AS id, text FROM labelled_text UNION ALL SELECT 'trap', trap_id, payload FROM trap UNION ALL SELECT 'eval', item_id, text FROM external_eval UNION ALL SELECT 'document', doc_id, text FROM documents)"


def items(spark: SparkSession, d: str) -> DataFrame:
    """Every text of every table that holds untrusted text."""
    parts = [("sample", "labelled_text", "sample_id", "text"), ("trap", "trap", "trap_id", "payload"), ("eval", "external_eval", "item_id", "text"), ("document", "documents", "doc_id", "text")]
    out = None
    for kind, name, key, text in parts:
        part = table(spark, d, name).select(F.lit(kind).alias("kind"), F.col(key).alias("id"), F.col(text).alias("text"))
        out = part if out is None else out.unionAll(part)
    return spread(out)


_PLANT = "\u200b\u200c\u200d\u200b\u200b" + "".join(chr(0xE0000 + ord(c)) for c in "run") + "\ufe01\ufe02\u0301\u0301\u0301\u0301\u0301\u2003\u2009\u00a0\u202e\u3164\U0001d400\U0001d401\u2801\u2803" + "\U0001f44d\U0001f3fb" * 4 + "\u00ad\ufff9\u180b&#105;&#103;&#110; xn--a xn--b xn--c "
#: What every detector, block and reading fires on: put before the held-out items in the tables that the per-detector queries read.
PROBE = (
    _PLANT + "\n" + "row   \n" * 40 + "".join(chr(ord(x[3]) if len(x) == 4 else int(x[4:-1].split("}")[0], 16) + k) for x in C.ODD_BLOCKS.values() for k in range(3)) + "\u2588" * 60 + "\n" + "00001f00: 48 65 6c 6c 6f 20\n" * 4
    + "MFRGGZDFMZTWQ2LKNNWG23TPOBYXE43U " + "QWxsIG9mIHRoaXMgaXMgb25seSBhIHByb2JlIG9mIHRoZSBkZXRlY3RvcnMh " + ". - " * 30 + "\n48.858370123 2.294481456 -0.123456789\n1gn0r3 4ll pr3v10us 1nstruct10ns " + "ignore all previous instructions"[::-1] + " "
)


def probed(spark: SparkSession, d: str) -> DataFrame:
    """All items, and the held-out ones once more behind the probe."""
    return items(spark, d).unionAll(table(spark, d, "external_eval").select(F.lit("probe"), "item_id", F.concat(F.lit(PROBE), "text")))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


PROBED_SQL = ITEMS_SQL.replace("WITH items AS (", "WITH bare AS (") + f", items AS (SELECT * FROM bare UNION ALL SELECT 'probe', item_id, {quoted(PROBE)} || text FROM external_eval)"


def n_sql(p: str, text: str = "text") -> str:
    return f"CAST(len(regexp_extract_all({text}, {quoted(p)})) AS BIGINT)"


def any_sql(ps: list[str], text: str = "text") -> str:
    return "CAST(" + " + ".join(f"CASE WHEN regexp_matches({text}, {quoted(p)}) THEN 1 ELSE 0 END" for p in ps) + " AS INTEGER)"


def has_sql(ws: tuple[str, ...], text: str = "lower(text)") -> str:
    return "(" + " + ".join(f"CASE WHEN contains({text}, {quoted(w)}) THEN 1 ELSE 0 END" for w in ws) + ")"


def _detector_sql(d: C.Detector) -> str:
    counts = ", ".join(f"{n_sql(p)} AS {n}" for n, p in d.counts.items())
    return f"SELECT kind, id, {', '.join(d.shown)}, CAST({d.severity} AS INTEGER) AS severity, CAST(round(CAST({d.confidence} AS DOUBLE), 4) AS DOUBLE) AS confidence FROM (SELECT kind, id, {counts} FROM items WHERE text IS NOT NULL) WHERE {d.where}"


def _add(name: str, query: Q, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


for _d in C.DETECTORS:
    _add(f"detect_{_d.name}", lambda s, d, det=_d: scan.detector_rows(probed(s, d), det), f"{PROBED_SQL} {_detector_sql(_d)}")

_ALL = " UNION ALL ".join(f"SELECT kind, id, {quoted(d.name)} AS detector, {quoted(d.method)} AS method, severity, confidence FROM ({_detector_sql(d)})" for d in C.DETECTORS)
_add("scan_findings", lambda s, d: scan.findings(items(s, d)).drop("seq"), f"{ITEMS_SQL} {_ALL}")
_add(
    "report_rollup", lambda s, d: scan.reports(items(s, d)),
    f"{ITEMS_SQL} SELECT a.kind, a.id, a.deliveries, coalesce(f.n, 0) AS finding_count, coalesce(f.h, 0) AS highest_severity, f.n IS NULL AS clean FROM (SELECT kind, id, count(*) AS deliveries FROM items GROUP BY kind, id) a LEFT JOIN (SELECT kind, id, count(*) AS n, max(severity) AS h FROM ({_ALL}) GROUP BY kind, id) f ON a.kind = f.kind AND a.id = f.id",
)
_add(
    "odd_blocks", lambda s, d: probed(s, d).filter("text IS NOT NULL").select("kind", "id", scan.count_of(F.col("text"), C.LATIN).alias("latin"), F.length("text").alias("n"), F.explode(F.array(*[F.struct(F.lit(b).alias("block"), scan.count_of(F.col("text"), p).alias("hits")) for b, p in C.ODD_BLOCKS.items()])).alias("x")).select("kind", "id", "x.block", "x.hits", "latin", "n").filter((F.col("hits") >= 3) & (~F.col("block").isin(*C.NATURAL_BLOCKS) | (F.col("latin") >= 0.5 * F.col("n")))).select("kind", "id", "block", "hits"),
    f"{PROBED_SQL} " + " UNION ALL ".join(f"SELECT kind, id, {quoted(b)} AS block, {n_sql(p)} AS hits FROM items WHERE text IS NOT NULL AND {n_sql(p)} >= 3" + (f" AND {n_sql(C.LATIN)} >= 0.5 * length(text)" if b in C.NATURAL_BLOCKS else "") for b, p in C.ODD_BLOCKS.items()),
)
_clean = "text"
for _p in (C.ZERO_WIDTH, C.INTERLINEAR, C.MONGOLIAN_VS, C.TAGS, C.VARIATION, C.BIDI, C.FILLERS):
    _clean = f"regexp_replace({_clean}, {quoted(_p)}, '', 'g')"
_clean = f"regexp_replace({_clean}, {quoted(C.SPACES)}, ' ', 'g')"
_clean = f"replace(translate({_clean}, {quoted(C.LOOKALIKE_FROM + C.FULLWIDTH_FROM)}, {quoted(C.LOOKALIKE_TO + C.FULLWIDTH_TO)}), {quoted(C.ROMAN_TWO)}, 'II')"
_clean = f"regexp_replace({_clean}, {quoted(f'({C.COMBINING}{{2}}){C.COMBINING}+')}, '\\1', 'g')"
_add("sanitize_text", lambda s, d: items(s, d).filter("text IS NOT NULL").select("kind", "id", F.md5(scan.sanitized(F.col("text"))).alias("clean_md5"), F.length(scan.sanitized(F.col("text"))).cast("bigint").alias("clean_chars")), f"{ITEMS_SQL} SELECT kind, id, md5({_clean}) AS clean_md5, length({_clean}) AS clean_chars FROM items WHERE text IS NOT NULL")

_skeleton = "regexp_replace(lower(text), '[^b-df-hj-np-tv-z]', '', 'g')"
_hits = " UNION ALL ".join([f"SELECT rn, kind, id, {quoted(c)} AS category FROM t WHERE regexp_matches(text, {quoted(p)})" for c, p in C.RULES] + [f"SELECT rn, kind, id, 'vowel_skeleton' FROM t WHERE length({_skeleton}) >= 12 AND {has_sql(C.SKELETONS, _skeleton)} > 0"])
_sev = f"CASE WHEN category IN ({', '.join(map(quoted, (*C.CRITICAL, 'multi_vector')))}) THEN 4 WHEN category IN ({', '.join(map(quoted, C.HIGH))}) THEN 3 ELSE 2 END"
_add(
    "injection_categories", lambda s, d: scan.injection_categories(items(s, d)),
    f"{ITEMS_SQL}, t AS (SELECT row_number() OVER () AS rn, * FROM items WHERE text IS NOT NULL), h AS (SELECT DISTINCT * FROM ({_hits})), a AS (SELECT * FROM h UNION ALL SELECT rn, kind, id, 'multi_vector' FROM h GROUP BY rn, kind, id HAVING count(*) >= 3) SELECT kind, id, category, {_sev} AS severity FROM a",
)
_add(
    "injection_by_category", lambda s, d: scan.injection_categories(items(s, d)).groupBy("kind", "category").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_items")),
    f"{ITEMS_SQL}, t AS (SELECT row_number() OVER () AS rn, * FROM items WHERE text IS NOT NULL), h AS (SELECT DISTINCT * FROM ({_hits})), a AS (SELECT * FROM h UNION ALL SELECT rn, kind, id, 'multi_vector' FROM h GROUP BY rn, kind, id HAVING count(*) >= 3) SELECT kind, category, count(*) AS n, count(DISTINCT id) AS n_items FROM a GROUP BY kind, category",
)
_leet = f"translate(translate(text, {quoted(C.LOOKALIKE_FROM + C.FULLWIDTH_FROM)}, {quoted(C.LOOKALIKE_TO + C.FULLWIDTH_TO)}), {quoted(C.LEET_FROM)}, {quoted(C.LEET_TO)})"
_over = C.RULES[0][1]


def _variants(s: SparkSession, d: str) -> DataFrame:
    plain = F.translate("text", C.LOOKALIKE_FROM + C.FULLWIDTH_FROM, C.LOOKALIKE_TO + C.FULLWIDTH_TO)
    rows = probed(s, d).filter("text IS NOT NULL").select("kind", "id", F.col("text").rlike(_over).alias("as_is"), plain.rlike(_over).alias("look_alikes"), F.translate(plain, C.LEET_FROM, C.LEET_TO).rlike(_over).alias("leet"), F.reverse("text").rlike(_over).alias("reversed"))
    return rows.filter("as_is OR look_alikes OR leet OR reversed")


_add("injection_variants", _variants, f"{PROBED_SQL} SELECT * FROM (SELECT kind, id, regexp_matches(text, {quoted(_over)}) AS as_is, regexp_matches(translate(text, {quoted(C.LOOKALIKE_FROM + C.FULLWIDTH_FROM)}, {quoted(C.LOOKALIKE_TO + C.FULLWIDTH_TO)}), {quoted(_over)}) AS look_alikes, regexp_matches({_leet}, {quoted(_over)}) AS leet, regexp_matches(reverse(text), {quoted(_over)}) AS reversed FROM items WHERE text IS NOT NULL) WHERE as_is OR look_alikes OR leet OR reversed")


def _rule_variants(s: SparkSession, d: str) -> DataFrame:
    """Every rule on every light variant: one row per text, variant and category."""
    return scan.rule_variants(items(s, d))


_add("injection_rule_variants", _rule_variants)

_pol = ", ".join(f"{n_sql(p)} AS {n}" for n, p in (("n_words", r"\S+"), ("superlatives", C.SUPERLATIVE), ("hedges", C.HEDGE), ("positive", C.POSITIVE), ("negative", C.NEGATIVE)))
_add("polarization_score", lambda s, d: scan.polarization(items(s, d)), f"{ITEMS_SQL} SELECT kind, id, n_words, superlatives, hedges, {scan.POLARIZATION_SQL} AS score FROM (SELECT kind, id, {_pol} FROM items WHERE text IS NOT NULL) WHERE n_words >= 30")
_fr = ", ".join(f"{any_sql(ps)} AS {n}" for n, ps in C.FRAMING.items())
_add("framing_score", lambda s, d: scan.framing(items(s, d)), f"{ITEMS_SQL} SELECT * FROM (SELECT kind, id, {scan.FRAMING_SQL} AS score FROM (SELECT kind, id, {_fr} FROM items WHERE text IS NOT NULL AND length(text) >= 20)) WHERE score > 0")
_add("chunk_poisoning", lambda s, d: scan.chunk_poisoning(items(s, d)), f"{ITEMS_SQL} SELECT *, CASE WHEN smuggling > 0 THEN 4 ELSE 3 END AS severity FROM (SELECT kind, id, {any_sql(C.SMUGGLING)} AS smuggling, {any_sql(C.SPOOFING)} AS spoofing, {any_sql(C.CONTRADICTION)} AS contradiction FROM items WHERE text IS NOT NULL AND length(text) >= 15) WHERE smuggling > 0 OR spoofing >= 2 OR contradiction > 0")
_add(
    "repetition_bombing", lambda s, d: scan.repetition(items(s, d)),
    f"{ITEMS_SQL}, t AS (SELECT row_number() OVER () AS rn, kind, id, unnest(regexp_split_to_array(lower(text), '[.!?\\n]+')) AS s FROM items WHERE text IS NOT NULL), c AS (SELECT rn, kind, id, trim(s) AS s, count(*) AS n FROM t WHERE length(trim(s)) >= 10 GROUP BY ALL) SELECT kind, id, max(n) AS repeats FROM c GROUP BY rn, kind, id HAVING max(n) >= 3",
)
_add(
    "html_vectors", lambda s, d: scan.html_vectors(items(s, d)),
    f"{ITEMS_SQL} " + " UNION ALL ".join(f"SELECT kind, id, {quoted(v)} AS vector, CAST(len(regexp_extract_all(text, {quoted(p)}, 1)) AS BIGINT) AS n, CAST(length(coalesce(array_to_string(regexp_extract_all(text, {quoted(p)}, 1), ''), '')) AS BIGINT) AS chars FROM items WHERE len(regexp_extract_all(text, {quoted(p)}, 1)) > 0" for v, p in C.HTML_VECTORS.items()),
)
_add(
    "heuristic_features", lambda s, d: scan.heuristic_features(items(s, d)),
    f"""{ITEMS_SQL} SELECT kind, id, round(least({has_sql(C.KEYWORDS)} / 5e0, 1e0), 6) AS keywords,
    CASE WHEN {has_sql(C.CREDENTIALS)} > 0 AND {has_sql(C.CREDENTIAL_ACTIONS)} > 0 THEN 1e0 WHEN {has_sql(C.CREDENTIALS)} > 0 THEN 0.5e0 ELSE 0e0 END AS credentials,
    round(least({has_sql(C.URGENCY_WORDS)} / 3e0, 1e0), 6) AS urgency, CASE WHEN {has_sql(C.ROLE_WORDS)} > 0 THEN 1e0 ELSE 0e0 END AS role_hijack, round(least({has_sql(C.TASK_WORDS)} / 3e0, 1e0), 6) AS task_markers,
    CASE WHEN {has_sql(C.AUTHORITY_WORDS)} > 0 THEN 1e0 ELSE 0e0 END AS authority, round({n_sql('[^\\p{L}\\p{N}\\s]')} * 1e0 / greatest(length(text), 1), 6) AS special_ratio,
    CASE WHEN length(text) < 50 THEN 0e0 WHEN length(text) < 500 THEN 0.5e0 ELSE 1e0 END AS length_bucket,
    CASE WHEN regexp_matches(text, '(?i)"(?:tool_call|function_call|tool_use|action|execute|command|cmd|shell|eval|run_sql)"') THEN 1e0 ELSE 0e0 END AS tool_call,
    CASE WHEN regexp_matches(text, '(?:FRAGMENT|CONTEXT_|PART_|SECTION_|CHUNK_)\\d*') THEN 1e0 ELSE 0e0 END AS fragment_marker FROM items WHERE text IS NOT NULL""",
)

# Guards over the event log: the event type stands for the tool, the user for the session.
_add(
    "rate_limit_window", lambda s, d: guards.rate_limited(table(s, d, "events"), "event_type", "ts", 30).select("event_id", "recent", "limited"),
    "SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) AS recent, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 59999999 MICROSECONDS PRECEDING AND CURRENT ROW) > 30 AS limited FROM events",
)
_add(
    "circuit_breaker", lambda s, d: guards.circuit_breaker(table(s, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", F.col("n_last"), F.col("n_pairs").cast("bigint").alias("n_pairs"), "tripped"),
    "SELECT event_id, n_last, CAST(n_pairs AS BIGINT) AS n_pairs, n_last >= 6 AND n_pairs <= 2 AS tripped FROM (SELECT event_id, count(*) OVER w AS n_last, len(list_distinct(list(event_type) OVER w)) AS n_pairs FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))",
)
_add(
    "action_guard", lambda s, d: guards.action_verdicts(table(s, d, "trap").select("trap_id", "method"), "method").select("trap_id", "verdict", "risk"),
    f"SELECT trap_id, CASE WHEN regexp_matches(method, {quoted(C.DESTRUCTIVE)}) THEN 'destructive' WHEN regexp_matches(method, {quoted(C.NETWORK)}) THEN 'network' ELSE 'allowed' END AS verdict, CASE WHEN regexp_matches(method, {quoted(C.DESTRUCTIVE)}) THEN 0.9e0 WHEN regexp_matches(method, {quoted(C.NETWORK)}) THEN 0.7e0 ELSE 0e0 END AS risk FROM trap",
)
_add(
    "fragment_guard", lambda s, d: guards.fragment_sessions(table(s, d, "trap"), "trap_id", "fragments"),
    f"SELECT trap_id, CAST(len(fragments) AS BIGINT) AS n_fragments, {any_sql(C.FRAGMENT_RULES, 'coalesce(array_to_string(fragments, chr(32)), chr(0))')} AS together, CAST(" + " + ".join(f"CASE WHEN len(list_filter(fragments, lambda x: regexp_matches(x, {quoted(p)}))) > 0 THEN 1 ELSE 0 END" for p in C.FRAGMENT_RULES) + " AS INTEGER) AS apart FROM trap WHERE fragments IS NOT NULL",
)
_cat = "lower(replace(trim(category), '-', '_'))"


def _battery(s: SparkSession, d: str) -> DataFrame:
    """Detection by category, by difficulty and overall: three groupings in one aggregation."""
    traps = items(s, d).filter("kind = 'trap'")
    caught = scan.findings(traps).select("id").union(scan.injection_categories(traps).select("id")).distinct().withColumn("caught", F.lit(1))
    one = table(s, d, "trap").groupBy(F.col("trap_id").alias("id")).agg(F.max(F.expr(_cat)).alias("category"), F.max("difficulty").alias("difficulty"))
    rows = one.join(caught, "id", "left").withColumn("caught", F.coalesce("caught", F.lit(0)))
    sets = rows.groupingSets([[F.col("category")], [F.col("difficulty")], []], "category", "difficulty")
    return sets.agg(F.count("*").alias("n"), F.sum("caught").alias("n_caught"), F.round(F.avg("caught"), 6).alias("rate"))


_trap_hits = f"SELECT id FROM ({_ALL}) WHERE kind = 'trap' UNION SELECT id FROM h WHERE kind = 'trap'"
_add(
    "battery_grouping_sets", _battery,
    f"{ITEMS_SQL}, t AS (SELECT row_number() OVER () AS rn, * FROM items WHERE text IS NOT NULL), h AS ({_hits}), c AS ({_trap_hits}), o AS (SELECT trap_id AS id, max({_cat}) AS category, max(difficulty) AS difficulty FROM trap GROUP BY trap_id), r AS (SELECT o.*, CASE WHEN c.id IS NULL THEN 0 ELSE 1 END AS caught FROM o LEFT JOIN c ON o.id = c.id) SELECT category, difficulty, count(*) AS n, CAST(sum(caught) AS BIGINT) AS n_caught, round(avg(caught), 6) AS rate FROM r GROUP BY GROUPING SETS ((category), (difficulty), ())",
)
_metrics = "sum(CASE WHEN p AND y THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN p AND NOT y THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN NOT p AND y THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN NOT p AND NOT y THEN 1 ELSE 0 END) AS tn"
_pred = f"regexp_matches(coalesce(text, ''), {quoted(C.RULES[2][1])}) OR regexp_matches(coalesce(text, ''), {quoted(C.RULES[8][1])})"


def _rule_metrics(s: SparkSession, d: str) -> DataFrame:
    """Two injection rules held against the labels."""
    t = F.coalesce("text", F.lit(""))
    rows = table(s, d, "labelled_text").filter("label IN (0, 1)").select((F.col("label") == 1).alias("y"), (t.rlike(C.RULES[2][1]) | t.rlike(C.RULES[8][1])).alias("p"))
    return rows.selectExpr(*[f"CAST({m} AS BIGINT) AS {n}" for m, n in (x.split(" AS ") for x in _metrics.split(", "))])


_add("rule_metrics", _rule_metrics, "SELECT " + ", ".join(f"CAST({m} AS BIGINT) AS {n}" for m, n in (x.split(" AS ") for x in _metrics.split(", "))) + f" FROM (SELECT label = 1 AS y, {_pred} AS p FROM labelled_text WHERE label IN (0, 1))")
_add(
    "mime_sniff", lambda s, d: items(s, d).select("kind", "id", F.when(F.col("text").isNull(), "none").when(F.col("text").rlike(r"(?is)^\s*(?:<!doctype html|<html|<[a-z]+[ >/])"), "text/html").when(F.col("text").rlike(r"(?s)^\s*[{\[]"), "application/json").when(F.col("text").rlike(r"^(?:[A-Za-z0-9+/]{4})+={0,2}$"), "application/base64").otherwise("text/plain").alias("mime")).groupBy("kind", "mime").agg(F.count("*").alias("n")),
    ITEMS_SQL + r" SELECT kind, mime, count(*) AS n FROM (SELECT kind, CASE WHEN text IS NULL THEN 'none' WHEN regexp_matches(text, '(?is)^\s*(?:<!doctype html|<html|<[a-z]+[ >/])') THEN 'text/html' WHEN regexp_matches(text, '(?s)^\s*[{\[]') THEN 'application/json' WHEN regexp_matches(text, '^(?:[A-Za-z0-9+/]{4})+={0,2}$') THEN 'application/base64' ELSE 'text/plain' END AS mime FROM items) GROUP BY kind, mime",
)


# Operators that SQL cannot express: rows only.
_add("decoded_layers", lambda s, d: decode.decoded_layers(items(s, d)).filter("method IN ('base64', 'hex', 'percent')").select("kind", "id", "method", F.length("decoded").alias("chars"), F.md5("decoded").alias("md5")))
_add("encoded_injection", lambda s, d: decode.encoded_injection(items(s, d)))
_add("heavy_injection", lambda s, d: decode.heavy_injection(items(s, d)))
_add("json_leaves", lambda s, d: structure.json_leaves(items(s, d)))
_add("json_sanitize", lambda s, d: structure.sanitized_json(items(s, d)))


def _scored(s: SparkSession, d: str) -> DataFrame:
    """A classifier fitted on the training split, scored on the held-out ones."""
    rows = table(s, d, "labelled_text").filter("label IN (0, 1) AND text IS NOT NULL").select(F.lit("sample").alias("kind"), F.col("sample_id").alias("id"), "text", F.col("label").cast("double").alias("y"), F.lower(F.trim("split")).startswith("train").alias("is_train"), F.col("ingested_at").alias("at"))
    latest = rows.filter("is_train IS NOT NULL AND id IS NOT NULL").groupBy("id").agg(F.max_by(F.struct("kind", "text", "y", "is_train"), F.struct("at", "text", "y")).alias("r"))
    rows = stage(classifier.with_features(spread(latest.select("id", "r.*"))), "classifier-rows").df  # read by every pass of the fit
    return classifier.score(classifier.train(rows.filter("is_train")), rows.filter("NOT is_train"))


_add("classifier_scores", lambda s, d: _scored(s, d).select("id", F.round("score", 6).alias("score"), "y"))
_add("classifier_metrics", lambda s, d: classifier.metrics(_scored(s, d)))
_add("threshold_sweep", lambda s, d: classifier.thresholds(_scored(s, d)))

_add(
    "planted_findings", lambda s, d: scan.findings(items(s, d).withColumn("text", F.concat(F.lit(_PLANT), "text"))).groupBy("kind", "detector", "severity").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence")),
    ITEMS_SQL.replace("WITH items AS (", "WITH unplanted AS (") + f", items AS (SELECT kind, id, {quoted(_PLANT)} || text AS text FROM unplanted) SELECT kind, detector, severity, count(*) AS n, round(avg(confidence), 6) AS confidence FROM ({_ALL}) GROUP BY kind, detector, severity",
)
