"""Files of any kind to the scans that fit them: kind by content and name, text by encoding, findings of all in one table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.functions import catalog as C
from veilscan.media.binary import scan_binary, sniff
from veilscan.operators.scan import findings, injection_categories

KINDS = "path string, format string, kind string, text string"
_PRINTED = 0.85


def decoded(data: bytes) -> str | None:
    """The text of a file: UTF-8 and UTF-16 with or without a mark, Latin-1 for the rest that can be printed; None for other bytes."""
    for mark, codec in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if data.startswith(mark):
            try:
                return data.decode(codec)
            except UnicodeDecodeError:
                break
    head = data[:200]
    if head.count(0) > 0.3 * len(head):
        for codec, zeros in (("utf-16-le", head[1::2]), ("utf-16-be", head[0::2])):
            if zeros.count(0) > 0.3 * max(1, len(zeros)):
                try:
                    return data.decode(codec)
                except UnicodeDecodeError:
                    continue
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    text = data.decode("latin-1")
    printed = sum(c.isprintable() or c in "\n\r\t" for c in text)
    return text if printed >= _PRINTED * len(text) else None


def kind_of(path: str, data: bytes) -> tuple[str, str, str | None]:
    """(format, kind, text): by signature first; by extension and encoding where no signature is known."""
    form = sniff(data)
    kind = C.FILE_KINDS.get(form)
    if kind not in (None, "text"):
        return form, kind, None
    text = decoded(data) if kind == "text" or form == "unknown" else None
    named = path.rpartition(".")[2].lower() in C.TEXT_EXTENSIONS
    if text is not None and ("\x00" not in text or named):
        return (form if form == "rtf" else "text"), "text", text
    return form, "binary", None


def routed(files: DataFrame) -> DataFrame:
    """(path, format, kind, text) of (path, content) rows; kind is text, image, audio, pdf or binary, text is NULL for all but text.

    Null contents give no row; an empty file is an empty text. Whole contents are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *kind_of(p or "", data)) for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], [c.split()[0] for c in KINDS.split(", ")])

    return files.filter("content IS NOT NULL").select("path", "content").mapInArrow(run, KINDS)


def scan_files(files: DataFrame) -> DataFrame:
    """(path, kind, detector, severity) of all files: character channels and injected wording of texts and of file names, and the binary scan of every file."""
    known = routed(files)
    texts = known.filter("kind = 'text'").select(F.lit("text").alias("kind"), F.col("path").alias("id"), "text")
    names = known.select(F.lit("name").alias("kind"), F.col("path").alias("id"), F.regexp_extract("path", r"([^/]*)\z", 1).alias("text"))
    items = texts.unionAll(names)
    found = findings(items).select(F.col("id").alias("path"), "kind", "detector", "severity")
    found = found.unionAll(injection_categories(items).select(F.col("id").alias("path"), "kind", F.col("category").alias("detector"), "severity"))
    return found.unionAll(scan_binary(files).select("path", F.lit("bytes").alias("kind"), "detector", "severity"))


def file_reports(files: DataFrame) -> DataFrame:
    """(path, kind, finding_count, highest_severity, clean): one report a file, those without findings too."""
    one = scan_files(files).groupBy("path").agg(F.count("*").alias("n"), F.max("severity").alias("top"))
    rows = routed(files).select("path", "kind").join(one, "path", "left")
    return rows.select("path", "kind", F.coalesce("n", F.lit(0)).alias("finding_count"), F.coalesce("top", F.lit(0)).alias("highest_severity"), F.col("n").isNull().alias("clean"))
