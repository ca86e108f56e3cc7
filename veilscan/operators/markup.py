"""Markup: hidden elements, comments, long labels, and copies without them, by a parse of each document in one Arrow kernel."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

# Styles and classes that hide an element, and its lengths that are odd.
HIDDEN_STYLES = {
    "display:none": r"display\s*:\s*none",
    "visibility:hidden": r"visibility\s*:\s*hidden",
    "opacity:0": r"opacity\s*:\s*0(?:[;\s]|$)",
    "font-size:0": r"font-size\s*:\s*0(?:px|em|rem|%)?\s*[;\s]",
    "font-size:1px": r"font-size\s*:\s*[01]px",
    "height:0": r"height\s*:\s*0(?:px)?\s*[;\s].*overflow\s*:\s*hidden",
    "width:0": r"width\s*:\s*0(?:px)?\s*[;\s].*overflow\s*:\s*hidden",
    "offscreen-position": r"(?:left|top)\s*:\s*-\d{3,}px",
    "text-indent-offscreen": r"text-indent\s*:\s*-\d{3,}",
}
HIDDEN_CLASSES = frozenset(("hidden", "invisible", "offscreen", "sr-only", "visually-hidden", "hidden-trap", "d-none", "hide"))
LONG_COMMENT, LONG_VALUE, KEPT_COMMENT = 20, 50, 5
_STYLES = [(name, re.compile(p, re.I | re.S)) for name, p in HIDDEN_STYLES.items()]
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FOUND = "kind string, id bigint, technique string, tag string, severity int, confidence double, payload string"


def hidden_by(attrs: dict[str, str | None]) -> str | None:
    """Why an element is not seen; None for one that is."""
    style = attrs.get("style") or ""
    for name, p in _STYLES:
        if p.search(style):
            return name
    if "hidden" in attrs:
        return "hidden-attribute"
    if (attrs.get("aria-hidden") or "").lower() == "true":
        return "aria-hidden"
    named = HIDDEN_CLASSES & set((attrs.get("class") or "").lower().split())
    return f"class:{min(named)}" if named else None


class _Reader(HTMLParser):
    """Findings, and the document without what hides; unclosed elements end with their parent."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=False)
        self.open: list[tuple[str, str | None, list[str]]] = []  # tag, why hidden, text inside
        self.dropped = 0  # open elements that are left out of the copy
        self.found: list[tuple[str, str, int, float, str]] = []
        self.clean: list[str] = []

    def _copy(self, text: str) -> None:
        if not self.dropped:
            self.clean.append(text)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        known = dict(attrs)
        label, content, why = known.get("aria-label") or "", known.get("content") or "", hidden_by(known)
        if len(label) > LONG_VALUE:
            self.found.append(("aria-label-injection", tag, 2, 0.7, label))
        odd_meta = tag == "meta" and (known.get("name") or "").lower() not in ("charset", "viewport") and len(content) > LONG_VALUE
        if odd_meta:
            self.found.append(("meta-injection", tag, 2, 0.6, content))
        json_ld = tag == "script" and (known.get("type") or "").lower() == "application/ld+json"
        if tag in _VOID:
            if not odd_meta and not why:
                self._copy(self._tag(tag, attrs))
            return
        gone = bool(why or json_ld)
        self.dropped += gone
        self._copy(self._tag(tag, attrs))
        self.open.append((tag, why or ("json-ld" if gone else None), []))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _tag(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        kept = [(k, v) for k, v in attrs if not (k == "aria-label" and len(v or "") > LONG_VALUE)]
        return "<" + tag + "".join(f" {k}" if v is None else f' {k}="{escape(v)}"' for k, v in kept) + ">"

    def handle_endtag(self, tag: str) -> None:
        if not any(t == tag for t, _, _ in self.open):
            return
        while self.open:
            name, why, text = self.open.pop()
            inside = "".join(text).strip()
            if why and why != "json-ld" and inside:
                self.found.append((why, name, 3, 0.9, inside))
            if not why:
                self._copy(f"</{name}>")
            self.dropped -= why is not None
            if self.open:
                self.open[-1][2].extend(text)
            if name == tag:
                break

    def handle_data(self, data: str) -> None:
        if self.open:
            self.open[-1][2].append(data)
        self._copy(data)

    def handle_entityref(self, name: str) -> None:
        self.handle_data(f"&{name};")

    def handle_charref(self, name: str) -> None:
        self.handle_data(f"&#{name};")

    def handle_decl(self, decl: str) -> None:
        self._copy(f"<!{decl}>")

    def handle_comment(self, data: str) -> None:
        inside = data.strip()
        if len(inside) > LONG_COMMENT:
            self.found.append(("html-comment", "", 2, 0.7, inside))
        if len(inside) <= KEPT_COMMENT:
            self._copy(f"<!--{data}-->")


def read_markup(text: str) -> tuple[list[tuple[str, str, int, float, str]], str]:
    """(findings, clean copy) of one document."""
    reader = _Reader()
    reader.feed(text)
    reader.close()
    while reader.open:
        reader.handle_endtag(reader.open[-1][0])
    return reader.found, "".join(reader.clean)


def _markup(items: DataFrame) -> DataFrame:
    return items.filter("text RLIKE '<[A-Za-z!]'").selectExpr("kind", "CAST(id AS BIGINT) AS id", "text")


def hidden_markup(items: DataFrame) -> DataFrame:
    """(kind, id, technique, tag, severity, confidence, payload) of everything hidden in the items that hold markup; others give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [c.split()[0] for c in FOUND.split(", ")], (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string())
        for batch in batches:
            rows = [(kind, i, *f) for kind, i, text in zip(*(c.to_pylist() for c in batch.columns)) for f in read_markup(text)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    return _markup(items).mapInArrow(run, FOUND)


def clean_markup(items: DataFrame) -> DataFrame:
    """(kind, id, clean) of the items that hold markup: hidden elements, comments, long labels and metadata left out, all else kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = [read_markup(t)[1] for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(clean, pa.string())], ["kind", "id", "clean"])

    return _markup(items).mapInArrow(run, "kind string, id bigint, clean string")
