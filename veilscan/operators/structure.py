"""JSON texts: leaves with their paths, odd keys and numeric channels, canonical copies."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in key names that point at a hidden channel.
ODD_KEYS = ("hidden", "secret", "payload", "covert", "steg", "encoded", "exfil", "backdoor")
_UUID = re.compile(r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", re.I)


def _leaves(top) -> Iterator[tuple[str, str, str]]:
    """(path, leaf, value) of every text leaf and byte list, in document order, however deep."""
    todo = [("$", top)]
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            todo.extend((f"{path}.{k}", v) for k, v in reversed(value.items()))
        elif isinstance(value, list):
            if len(value) >= 10 and all(isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 256 for x in value):
                text = "".join(map(chr, value))
                if sum(c.isprintable() for c in text) > 0.7 * len(text):
                    yield path, "numeric_channel", text
            todo.extend((f"{path}[{i}]", v) for i, v in reversed(list(enumerate(value))))
        elif isinstance(value, str):
            yield path, "string", value


def json_leaves(items: DataFrame) -> DataFrame:
    """(kind, id, path, leaf, value, odd_key) of every text leaf of the items that are JSON objects or arrays; others give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for kind, i, text in zip(pdf["kind"], pdf["id"], pdf["text"]):
                try:
                    rows += [(kind, i, *x) for x in _leaves(json.loads(text))]
                except (ValueError, TypeError, RecursionError):
                    continue
            yield pd.DataFrame(rows, columns=["kind", "id", "path", "leaf", "value"])

    some = items.filter(r"text RLIKE '^\\s*[{\\[]' AND id IS NOT NULL").select("kind", "id", "text")
    rows = some.mapInPandas(run, "kind string, id bigint, path string, leaf string, value string")
    return rows.withColumn("odd_key", F.lower(F.regexp_extract("path", r"([^.\[\]]+)(?:\[\d+\])*$", 1)).rlike("|".join(ODD_KEYS)))


def canonical_json(text: str | None) -> str | None:
    """Keys sorted, lists of strings sorted, UUIDs replaced by ones derived from the text alone; None for what is no JSON."""
    try:
        value = json.loads(text)
    except (ValueError, TypeError, RecursionError):
        return None

    def walk(v):
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        if isinstance(v, list):
            out = [walk(x) for x in v]
            return sorted(out) if all(isinstance(x, str) for x in out) else out
        return _UUID.sub(lambda m: str(uuid.uuid5(uuid.NAMESPACE_OID, m[0])), v) if isinstance(v, str) else v

    return json.dumps(walk(value), sort_keys=True, indent=2, ensure_ascii=False)


def sanitized_json(items: DataFrame) -> DataFrame:
    """(kind, id, clean) of the items that are JSON."""

    @F.pandas_udf("string")
    def clean(s: pd.Series) -> pd.Series:
        return s.map(canonical_json)

    return items.filter(r"text RLIKE '^\\s*[{\\[]'").select("kind", "id", clean("text").alias("clean")).filter("clean IS NOT NULL")
