"""Schemas that drift between the files of a lane: ordered change log, folded union schema, one typed table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.operators.ordering import ranged, with_previous
from veilscan.session import Stage, stage

#: A driver-side schema is folded only while it has at most this many field names.
MOST_FIELDS = 10_000


def _scalar_kind(t: Column) -> Column:
    return (
        F.when(t == "VOID", None)
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("OBJECT"), "object")
        .when(t.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "number")
    )


def value_kind(value: Column) -> Column:
    """string, number, boolean, object or array<one of these>; NULL for null, empty arrays and arrays of nulls."""
    t = F.schema_of_variant(value)
    inner = F.regexp_extract(t, r"^ARRAY<(.*)>$", 1)
    first = F.schema_of_variant(F.expr("try_variant_get(value, '$[0]', 'variant')"))
    inner = F.when(inner == "VARIANT", first).otherwise(inner)
    of = F.when(inner.startswith("ARRAY"), "array").otherwise(_scalar_kind(inner))
    return F.when(t.startswith("ARRAY"), F.concat(F.lit("array<"), of, F.lit(">"))).otherwise(_scalar_kind(t))


def read_lines(results: DataFrame) -> DataFrame:
    """One row per delivered line: repeated deliveries once, the time taken from the file's name."""
    rows = results.select("file_name", "lane", "suite", "line_no", "generated_at", "line")
    rows = rows.filter(F.col("file_name").isNotNull()).dropDuplicates(["file_name", "line_no", "line"])
    return rows.withColumns(
        {"file_time": F.regexp_extract("file_name", r"(\d{8}T\d{6}Z)\D*$", 1), "doc": F.try_parse_json("line")}
    )


def field_values(lines: DataFrame) -> DataFrame:
    """(file_name, line_no, field, kind, value as text) of every top-level field of every readable line."""
    each = lines.sparkSession.tvf.variant_explode(F.col("doc").outer())
    flat = lines.lateralJoin(each).filter("key IS NOT NULL").select("file_name", "line_no", F.col("key").alias("field"), "value")
    return flat.select("file_name", "line_no", "field", value_kind(F.col("value")).alias("kind"), F.expr("to_json(value)").alias("text"))


def file_schemas(values: DataFrame) -> DataFrame:
    """(file_name, field, kind): a header schema per file, kind by majority, ties to the first in the alphabet."""
    counts = values.groupBy("file_name", "field", "kind").agg(F.count("*").alias("n"))
    best = F.max_by("kind", F.when(F.col("kind").isNotNull(), F.struct("n", F.lit(-1) * F.ascii("kind"), F.length("kind"))))
    return counts.groupBy("file_name", "field").agg(best.alias("kind"), F.sum("n").alias("n"))


def _renames(values: DataFrame, ended: DataFrame, begun: DataFrame) -> DataFrame:
    """Ended and begun fields of one file paired by contents, best pair first, each field once.

    Contents are compared by the cosine of their token counts and by the share of lines, matched by number,
    that carry the same value; names only break ties.
    """
    pairs = ended.join(begun, ["file_name", "prev", "kind"]).filter("kind IS NOT NULL")
    need = pairs.select(F.col("prev").alias("file_name"), F.col("old").alias("field"))
    need = need.union(pairs.select("file_name", F.col("new").alias("field"))).distinct()
    text = values.join(need, ["file_name", "field"]).filter("text <> 'null'").select("file_name", "field", "line_no", "text")
    text = stage(text, "drift-text").df
    words = text.select("file_name", "field", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}_]+|[\d.]+"), F.lit(0))).alias("word"))
    bags = words.groupBy("file_name", "field", "word").agg(F.count("*").cast("double").alias("n"))
    norms = bags.groupBy("file_name", "field").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    old = lambda d, *cs: d.select(F.col("file_name").alias("prev"), F.col("field").alias("old"), *cs)
    new = lambda d, *cs: d.select("file_name", F.col("field").alias("new"), *cs)
    keys = ["file_name", "prev", "old", "new"]
    dots = (
        pairs.join(old(bags, "word", F.col("n").alias("n1")), ["prev", "old"])
        .join(new(bags, "word", F.col("n").alias("n2")), ["file_name", "new", "word"])
        .groupBy(*keys).agg(F.sum(F.col("n1") * F.col("n2")).alias("dot"))
    )
    same = (
        pairs.join(old(text, "line_no", F.col("text").alias("t1")), ["prev", "old"])
        .join(new(text, "line_no", F.col("text").alias("t2")), ["file_name", "new", "line_no"])
        .groupBy(*keys).agg(F.avg((F.col("t1") == F.col("t2")).cast("double")).alias("same"))
    )
    scored = (
        pairs.join(dots, keys, "left").join(same, keys, "left")
        .join(old(norms, F.col("norm").alias("norm1")), ["prev", "old"], "left")
        .join(new(norms, F.col("norm").alias("norm2")), ["file_name", "new"], "left")
        .withColumn("cosine", F.coalesce(F.col("dot") / F.col("norm1") / F.col("norm2"), F.lit(0.0)))
        .withColumn("same", F.coalesce("same", F.lit(0.0)))
        .filter(F.when(F.col("kind").isin("boolean", "number"), F.col("same") >= 0.3).otherwise((F.col("cosine") >= 0.1) | (F.col("same") >= 0.5)))
    )
    alike = 1 - F.levenshtein("old", "new") / F.greatest(F.length("old"), F.length("new"))
    scored = scored.withColumn("score", F.col("cosine") + F.col("same") + alike / 10)
    ranked = scored.groupBy("file_name").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "old", "new"))).alias("all"))
    picked = F.expr(
        "aggregate(all, cast(array() as array<struct<s:double,old:string,new:string>>),"
        " (got, x) -> if(exists(got, g -> g.old = x.old or g.new = x.new), got, array_append(got, x)))"
    )
    return ranked.select("file_name", F.explode(picked).alias("x")).select("file_name", F.col("x.old").alias("old"), F.col("x.new").alias("new"))


def drift_stages(results: DataFrame) -> tuple[Stage, Stage, Stage]:
    """(field values, file schemas, files in lane order with the file before each)."""
    lines = read_lines(results)
    values = stage(field_values(lines), "drift-values")
    schemas = stage(file_schemas(values.df), "drift-schemas")
    files = results.filter(F.col("file_name").isNotNull()).select("file_name", "lane").distinct()
    files = files.withColumn("file_time", F.regexp_extract("file_name", r"(\d{8}T\d{6}Z)\D*$", 1))
    order = ranged(files, ["lane", "file_time", "file_name"], "drift-files")
    return values, schemas, Stage(order.spark, order.path, with_previous(order.df, "lane", "file_name", "prev"))


def schema_changes(results: DataFrame, stages: tuple[Stage, Stage, Stage] | None = None) -> DataFrame:
    """Ordered differences between each file and the one before it in its lane.

    ``results`` has file_name, lane, line_no and line (one JSON object as text); other columns are ignored. Lines
    that cannot be read, and lines that are not objects, have no fields; a null file_name gives nothing. A file
    without readable lines ends all fields of the one before. Repeated lines count once. An empty table gives no
    changes. Files are ordered by range partitions with carried boundaries, so no lane is gathered in one task.
    """
    values, schemas, files = stages or drift_stages(results)
    order = files.df.filter("prev IS NOT NULL").select("file_name", "prev")
    now = schemas.df.join(order, "file_name").select("file_name", "prev", "field", F.col("kind").alias("kind_now"), F.lit(True).alias("is"))
    old = schemas.df.withColumnRenamed("file_name", "prev").join(order, "prev")
    old = old.select("file_name", "prev", "field", F.col("kind").alias("kind_old"), F.lit(True).alias("was"))
    diff = stage(now.join(old, ["file_name", "prev", "field"], "full").filter("is IS NULL OR was IS NULL OR kind_now <> kind_old"), "drift-diff").df
    ended = diff.filter("is IS NULL").select("file_name", "prev", F.col("field").alias("old"), F.col("kind_old").alias("kind"))
    begun = diff.filter("was IS NULL").select("file_name", "prev", F.col("field").alias("new"), F.col("kind_now").alias("kind"))
    renamed = stage(_renames(values.df, ended, begun), "drift-renames").df
    blank = F.lit("")
    row = lambda d, a, b, what: d.select("file_name", a.alias("old_field"), b.alias("new_field"), F.lit(what).alias("change_kind"))
    added = begun.join(renamed.select("file_name", "new"), ["file_name", "new"], "left_anti")
    removed = ended.join(renamed.select("file_name", "old"), ["file_name", "old"], "left_anti")
    return (
        row(added, blank, F.col("new"), "added")
        .unionByName(row(removed, F.col("old"), blank, "removed"))
        .unionByName(row(diff.filter("is AND was"), F.col("field"), F.col("field"), "retyped"))
        .unionByName(row(renamed, F.col("old"), F.col("new"), "renamed"))
    )


#: The promotion lattice: a set of kinds goes to its least upper bound.
def promote(kinds: set[str]) -> str:
    """Least type that holds all kinds: one kind keeps it, boolean and number join at number, all else at string."""
    known = {k for k in kinds if k}
    if not known or known == {"string"}:
        return "string"
    if len(known) == 1:
        return known.pop()
    return "number" if known == {"boolean", "number"} else "string"


def held_together(values: DataFrame, renames: DataFrame) -> set[tuple[str, str]]:
    """Pairs of renamed fields that one line holds both of, with values: they are two fields, whatever another lane calls them."""
    names = renames.select(F.explode(F.array("old_field", "new_field")).alias("field")).distinct()
    some = values.filter("text <> 'null'").join(names, "field", "left_semi").select("file_name", "line_no", "field").distinct()
    sets = some.groupBy("file_name", "line_no").agg(F.array_sort(F.collect_list("field")).alias("a")).filter("size(a) > 1").select("a").distinct()
    pairs = sets.select(F.explode("a").alias("x"), "a").select("x", F.explode("a").alias("y")).filter("x < y").distinct()
    got = pairs.limit(MOST_FIELDS + 1).collect()
    if len(got) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} pairs of renamed fields: keys look like data, not like a schema")
    return {(r.x, r.y) for r in got}


def union_schema(schemas: DataFrame, renames: DataFrame, apart: set[tuple[str, str]] = frozenset()) -> dict[str, tuple[list[str], str]]:
    """canonical field -> (its names, promoted type), folded over all file schemas.

    Names that a rename links become one field unless that put two names of ``apart`` together. Only distinct names and
    kinds come to the driver: that is the schema itself, refused beyond MOST_FIELDS.
    """
    seen = schemas.groupBy("field").agg(F.collect_set("kind").alias("kinds"), F.count("*").alias("n")).limit(MOST_FIELDS + 1).collect()
    links = renames.groupBy("old_field", "new_field").agg(F.count("*").alias("n")).limit(MOST_FIELDS + 1).collect()
    if max(len(seen), len(links)) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} field names: keys look like data, not like a schema")
    names = {r.field: [r.field] for r in seen}
    for r in links:
        names.setdefault(r.old_field, [r.old_field])
        names.setdefault(r.new_field, [r.new_field])
    for r in sorted(links, key=lambda r: (-r.n, r.old_field, r.new_field)):  # the most frequent renames first
        one, two = names[r.old_field], names[r.new_field]
        if one is not two and not any((min(x, y), max(x, y)) in apart for x in one for y in two):
            one += two
            names.update(dict.fromkeys(two, one))
    by_name = {r.field: r for r in seen}
    out = {}
    for group in {id(g): g for g in names.values()}.values():
        rows = sorted((by_name[f] for f in group if f in by_name), key=lambda r: (-r.n, r.field))
        if rows:
            out[rows[0].field] = ([r.field for r in rows], promote({k for r in rows for k in r.kinds}))
    return dict(sorted(out.items()))


def unified_table(results: DataFrame) -> DataFrame:
    """All results in one table: a column per canonical field, cast to the union schema, one row per readable line.

    A renamed field is one column under its most frequent name; two names that some line holds both keep their own columns.

    A column that met several kinds from file to file is text and keeps every value; a single value of another kind that
    cannot be cast to its column's type is NULL there and stands, as text, in the map ``unfit`` under its field. ``generated_at`` is restored from the file's name.
    Field columns are prefixed ``f_`` so that they never clash with the file's own columns.
    """
    stages = drift_stages(results)
    changes = schema_changes(results, stages).filter("change_kind = 'renamed'")
    changes = stage(changes, "drift-renamed").df
    fields = union_schema(stages[1].df, changes, held_together(stages[0].df, changes))
    to = {"string": "string", "number": "double", "boolean": "boolean", "array<string>": "array<string>", "array<number>": "array<double>", "array<boolean>": "array<boolean>"}
    cols, unfit = [], []
    for name, (names, kind) in fields.items():
        parts, texts = [], []
        for n in names:
            at = "'$[\"" + n.replace("\\", "\\\\").replace("'", "\\'").replace('"', '\\"') + "\"]'"
            parts.append(F.expr(f"try_variant_get(doc, {at}, '{to.get(kind, 'string')}')"))
            texts.append(F.expr(f"try_variant_get(doc, {at}, 'string')"))
        value = F.coalesce(*parts)
        cols.append(value.alias("f_" + name))
        if to.get(kind, "string") != "string":
            raw = F.coalesce(*texts)
            unfit += [F.lit(name), F.when(value.isNull(), raw)]
    lines = read_lines(results).filter("schema_of_variant(doc) LIKE 'OBJECT%'")
    rest = F.map_filter(F.create_map(*unfit), lambda k, v: v.isNotNull()) if unfit else F.expr("cast(map() as map<string,string>)")
    when = F.coalesce("generated_at", F.to_timestamp("file_time", "yyyyMMdd'T'HHmmss'Z'").cast(results.schema["generated_at"].dataType))
    return lines.select("file_name", "lane", "suite", "line_no", when.alias("generated_at"), *cols, rest.alias("unfit"))
