"""Nested JSON records to flat tables: Merkle identities for objects, bridge rows for every occurrence."""

from __future__ import annotations

import hashlib
import json
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Field names that hold containers are schema, not data; beyond this many the operator refuses to go on.
MOST_FIELDS = 50_000
OCCURRENCES = "report_id bigint, parent_path string, path string, ordinal int, parent_object string, holder_path string, holder_object string, object_id string, body string"
SCALARS = "object_id string, field string, value string, kind string"


def _read(text: str | None) -> dict | None:
    sys.setrecursionlimit(20_000)
    try:
        value = json.loads(text) if text else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def _decoded(value: str) -> dict | list | None:
    """What a string of JSON holds, however often it was wrapped; None unless an object or an array."""
    while isinstance(value, str):
        if value.lstrip()[:1] not in ("{", "[", '"'):
            return None
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, (dict, list)) else None


def container_fields(reports: DataFrame) -> dict[str, str]:
    """field name -> 'array' or 'object', by what the field natively holds in most reports.

    Strings of JSON do not count themselves, but once a field is known as a container, what its strings hold does not
    add names either: every name met there is met natively elsewhere or is taken as it comes.
    """

    def kinds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen: dict[str, list[int]] = {}
            for text in pdf["body"]:
                todo = [_read(text) or {}]
                while todo:
                    x = todo.pop()
                    if isinstance(x, dict):
                        for k, v in x.items():
                            if isinstance(v, (dict, list)):
                                seen.setdefault(k, [0, 0])[isinstance(v, list)] += 1
                                todo.append(v)
                    else:
                        todo.extend(v for v in x if isinstance(v, (dict, list)))
            yield pd.DataFrame([(k, o, a) for k, (o, a) in seen.items()], columns=["field", "objects", "arrays"])

    counts = reports.select("body").mapInPandas(kinds, "field string, objects bigint, arrays bigint")
    rows = counts.groupBy("field").agg(F.sum("objects").alias("o"), F.sum("arrays").alias("a")).limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} container fields: keys look like data, not like a schema")
    return {r.field: "array" if r.a >= r.o else "object" for r in rows}


class _Walker:
    """Flattens one report; objects are hashed bottom-up, so equal subtrees have equal ids wherever they occur."""

    def __init__(self, fields: dict[str, str]):
        self.fields = fields

    def report(self, report_id: int, record: dict) -> list[tuple]:
        self.rows: list[tuple] = []
        own, body = self._object(record, "", "report")
        held = {at: oid for _, at, _, _, oid, _ in self.rows} | {"": own}
        elements = {at: oid for _, at, n, _, oid, _ in self.rows if n is not None} | {"report": own}
        out = [(report_id, p, at, n, elements[p], h or "report", held[h], oid, body) for p, at, n, h, oid, body in self.rows]
        return [*out, (report_id, None, "report", 0, None, None, None, own, body)]

    def _object(self, value: dict, at: str, parent: str) -> tuple[str, str]:
        """(id, canonical body). The body names the objects it holds by their ids."""
        shown = {k: self._value(k, v, f"{at}.{k}" if at else k, parent, at) for k, v in value.items()}
        body = json.dumps(shown, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        return hashlib.blake2b(body.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest(), body

    def _value(self, field: str, value, at: str, parent: str, holder: str):
        kind = self.fields.get(field)
        if isinstance(value, str) and kind:
            inner = _decoded(value)
            value = value if inner is None else inner
        if isinstance(value, dict) and kind == "array":
            value = [value]
        if isinstance(value, dict):
            oid, body = self._object(value, at, parent)
            self.rows.append((parent, at, None, holder, oid, body))
            return {"$object": oid}
        if isinstance(value, list):
            return self._array(value, at, parent, holder)
        return value

    def _array(self, values: list, at: str, parent: str, holder: str) -> list:
        shown = []
        for i, v in enumerate(values):
            path = f"{at}[{i}]"
            if isinstance(v, dict):
                oid, body = self._object(v, path, path)
                self.rows.append((parent, path, i, holder, oid, body))
                shown.append({"$object": oid})
            else:
                shown.append(self._array(v, path, parent, holder) if isinstance(v, list) else v)
        return shown


def occurrences(reports: DataFrame) -> DataFrame:
    """Every occurrence of every object: bridge columns (report, parent, ordinal) plus its Merkle id and body.

    ``reports`` has report_id and body (JSON text). Bodies that are null, cut off, not objects, or nested deeper than the parser goes (thousands of levels) give no rows.
    Nulls in arrays keep their position; a lone object in a field that mostly holds arrays is element 0; a string
    of JSON counts as its value only in fields that elsewhere hold an object or an array. The report itself is the
    row with path ``report`` and no parent; an object that is no array element has no ordinal. The parent is the nearest
    enclosing array element or the report, the holder the nearest enclosing object of any kind. Repeated deliveries repeat their rows here; see ``bridge``.
    """
    fields = container_fields(reports)

    def flatten(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in OCCURRENCES.split(", ")]
        walk = _Walker(fields)
        for pdf in batches:
            rows: list[tuple] = []
            for rid, text in zip(pdf["report_id"], pdf["body"]):
                if (record := _read(text)) is not None and not pd.isna(rid):
                    try:
                        rows += walk.report(int(rid), record)
                    except RecursionError:
                        continue
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            yield pd.DataFrame(rows, columns=names)

    return reports.filter("report_id IS NOT NULL").select("report_id", "body").mapInPandas(flatten, OCCURRENCES)


def bridge(found: DataFrame) -> DataFrame:
    """One row per (report, path) of array elements: parent-child links with ordinals; deliveries that repeat a path count once."""
    return found.filter("parent_path IS NOT NULL AND ordinal IS NOT NULL").groupBy("report_id", "path").agg(
        *[F.first(F.struct("parent_path", "ordinal", "parent_object", "object_id")).alias("x")]
    ).select("report_id", "x.parent_path", "path", "x.ordinal", "x.parent_object", "x.object_id")


def full_bridge(found: DataFrame) -> DataFrame:
    """Every object with the object that holds it, reports (no parent) and plain nested objects (no ordinal) too.

    Deliveries of one report that differ at a path give a row each, so that every parent_object is an object_id.
    """
    return found.select("report_id", F.col("holder_path").alias("parent_path"), "path", "ordinal", F.col("holder_object").alias("parent_object"), "object_id").distinct()


def objects(found: DataFrame) -> DataFrame:
    """Identical array elements once: id, canonical body, how often and in how many reports they occur."""
    return full_objects(found.filter("parent_path IS NOT NULL AND ordinal IS NOT NULL"))


def full_objects(found: DataFrame) -> DataFrame:
    """Identical objects once, reports and plain nested objects too; a place of a report counts once, however often it is delivered."""
    places = found.groupBy("object_id", "report_id", "path").agg(F.first("body").alias("body"))
    by_report = places.groupBy("object_id", "report_id").agg(F.first("body").alias("body"), F.count("*").alias("n"))
    return by_report.groupBy("object_id").agg(F.first("body").alias("body"), F.sum("n").alias("n_occurrences"), F.count("*").alias("n_reports"))


def _scalars(field: str, value) -> Iterator[tuple[str, str | None, str]]:
    if isinstance(value, list) and value:
        for i, v in enumerate(value):
            yield from _scalars(f"{field}[{i}]", v)
    elif value is None:
        yield field, None, "null"
    elif isinstance(value, str):
        yield field, value, "string"
    elif not isinstance(value, dict):  # an object is named by its id and has rows of its own
        yield field, json.dumps(value), "array" if isinstance(value, list) else "boolean" if isinstance(value, bool) else "number"


def scalars(found: DataFrame) -> DataFrame:
    """(object_id, field, value, kind) of every scalar of every object; in arrays the field has its position, an empty array is ``[]``."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(oid, *r) for oid, body in zip(pdf["object_id"], pdf["body"]) for k, v in json.loads(body).items() for r in _scalars(k, v)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCALARS.split(", ")])

    return found.groupBy("object_id").agg(F.first("body").alias("body")).mapInPandas(split, SCALARS)
