"""Findings in binary files: signatures, containers in containers, PNG chunks, WAV chunks, least-significant bits."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilscan.media.pixels import statistics, twin_colours

#: File signatures.
SIGNATURES = {
    "png": b"\x89PNG\r\n\x1a\n", "jpeg": b"\xff\xd8\xff", "gif": b"GIF8", "pdf": b"%PDF-", "zip": b"PK\x03\x04", "gzip": b"\x1f\x8b\x08", "rar": b"Rar!\x1a\x07", "7z": b"7z\xbc\xaf\x27\x1c",
    "elf": b"\x7fELF", "riff": b"RIFF", "sqlite": b"SQLite format 3\x00", "midi": b"MThd", "rtf": b"{\\rtf", "pcap": b"\xd4\xc3\xb2\xa1", "flac": b"fLaC", "ogg": b"OggS",
}
FOUND = "path string, detector string, severity int, confidence double, evidence string"
_STANDARD_CHUNKS = set("IHDR PLTE IDAT IEND tEXt zTXt iTXt tIME pHYs gAMA cHRM sRGB iCCP bKGD hIST tRNS sBIT sPLT eXIf acTL fcTL fdAT".split())


def sniff(data: bytes) -> str:
    for name, magic in SIGNATURES.items():
        if data.startswith(magic):
            return name
    if data[257:262] == b"ustar":
        return "tar"
    try:
        data[:1000].decode("utf-8")
        return "text"
    except UnicodeDecodeError as e:
        return "text" if e.start > 990 else "unknown"


def chi_square_p(values: np.ndarray) -> float:
    """Probability that pairs of neighbouring values differ as little as they do (regularised incomplete gamma)."""
    h = np.bincount(values.ravel(), minlength=256).astype(float)
    even, odd = h[0::2], h[1::2]
    want = (even + odd) / 2
    ok = want > 5
    k = int(ok.sum()) - 1
    if k < 1:
        return 0.0
    x = float((((even - want) ** 2 + (odd - want) ** 2)[ok] / want[ok]).sum()) / 2
    a = k / 2
    if x <= 0:
        return 1.0
    if x < a + 1:  # series for the lower part
        term = total = 1 / a
        n = a
        while abs(term) > 1e-12 * abs(total):
            n += 1
            term *= x / n
            total += term
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h2 = d
    for i in range(1, 500):  # continued fraction for the upper part
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h2 *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return math.exp(-x + a * math.log(x) - math.lgamma(a)) * h2


def png_chunks(data: bytes) -> tuple[list[tuple[str, bytes]], bytes]:
    """Chunks and whatever follows IEND."""
    at, out = 8, []
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        out.append((kind.decode("latin-1"), data[at + 8 : at + 8 + size]))
        at += 12 + size
        if kind == b"IEND":
            return out, data[at:]
    return out, b""


def png_pixels(chunks: list[tuple[str, bytes]]) -> np.ndarray | None:
    """8-bit, not interlaced pixels, filters undone."""
    head = dict(chunks[:1]).get("IHDR")
    if not head or len(head) < 13:
        return None
    w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", head[:13])
    ch = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if depth != 8 or lace or not ch:
        return None
    try:
        raw = np.frombuffer(zlib.decompress(b"".join(d for k, d in chunks if k == "IDAT")), np.uint8)
    except zlib.error:
        return None
    stride = w * ch
    if len(raw) < h * (stride + 1):
        return None
    rows = raw[: h * (stride + 1)].reshape(h, stride + 1)
    out = np.zeros((h, stride), np.uint8)
    for y in range(h):
        kind, line = rows[y, 0], rows[y, 1:].astype(np.int32)
        up = out[y - 1].astype(np.int32) if y else np.zeros(stride, np.int32)
        if kind == 0:
            out[y] = line
        elif kind == 2:
            out[y] = (line + up) & 255
        else:
            cur = np.zeros(stride, np.int32)
            for x in range(stride):
                a = cur[x - ch] if x >= ch else 0
                b, c = up[x], up[x - ch] if x >= ch else 0
                if kind == 1:
                    p = a
                elif kind == 3:
                    p = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    p = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                cur[x] = (line[x] + p) & 255
            out[y] = cur
    return out.reshape(h, w, ch)


def _lsb(values: np.ndarray, where: str) -> Iterator[tuple]:
    if values.size >= 4096 and len(np.unique(values)) >= 24:
        p = chi_square_p(values.astype(np.uint8))
        if p > 0.05:  # natural values leave pairs uneven: p is then next to nothing
            yield "lsb_pairs", 3, round(0.5 + 0.45 * p, 4), f"{where}: value pairs are even"


def wav_chunks(data: bytes) -> tuple[list[tuple[str, bytes]], int]:
    at, out = 12, []
    end = min(len(data), 8 + struct.unpack("<I", data[4:8])[0]) if len(data) >= 12 else 0
    while at + 8 <= end:
        kind, size = struct.unpack("<4sI", data[at : at + 8])
        out.append((kind.decode("latin-1"), data[at + 8 : at + 8 + size]))
        at += 8 + size + size % 2
    return out, max(0, len(data) - end)


def findings_of(data: bytes) -> list[tuple[str, int, float, str]]:
    """(detector, severity, confidence, evidence) of one file's content."""
    kind, out = sniff(data), []
    for name, magic in SIGNATURES.items():
        if len(magic) > 3 and name != kind and (at := data.find(magic, 1)) > 0:
            out.append(("polyglot", 4, 0.9, f"{name} signature at {at} in {kind}"))
    if kind == "png":
        chunks, rest = png_chunks(data)
        if rest:
            out.append(("png_after_end", 4, 0.95, f"{len(rest)} bytes after IEND"))
        for c, d in chunks:
            if c not in _STANDARD_CHUNKS:
                out.append(("png_private_chunk", 3, 0.75, f"{c}, {len(d)} bytes"))
            elif c in ("tEXt", "iTXt", "zTXt") and len(d) > 1000:
                out.append(("png_large_text", 2, 0.6, f"{c}, {len(d)} bytes"))
        if (pixels := png_pixels(chunks)) is not None:
            out += [x for ch in range(pixels.shape[2]) for x in _lsb(pixels[:, :, ch], f"channel {ch}")]
        if "PLTE" in dict(chunks) and (twins := twin_colours(dict(chunks)["PLTE"])) > 5:
            out.append(("palette_twins", 3 if twins > 20 else 2, round(min(0.8, 0.4 + 0.02 * twins), 4), f"{twins} pairs"))
    elif kind == "jpeg" and (end := data.rfind(b"\xff\xd9")) > 0 and len(data) - end - 2 > 10:
        out.append(("jpeg_after_end", 4, 0.9, f"{len(data) - end - 2} bytes after the end marker"))
    elif kind == "gif" and (end := data.rfind(b"\x3b")) > 0 and len(data) - end - 1 > 10:
        out.append(("gif_after_end", 4, 0.9, f"{len(data) - end - 1} bytes after the trailer"))
    elif kind == "pdf":
        for mark, what in ((b"/JavaScript", "script"), (b"/OpenAction", "action")):
            if mark in data:
                out.append(("pdf_active", 3, 0.8, what))
        if data.count(b"%%EOF") >= 2:
            out.append(("pdf_updates", 2, 0.5, f"{data.count(b'%%EOF')} ends"))
        if (end := data.rfind(b"%%EOF")) >= 0 and len(data) - end - 5 > 100:
            out.append(("pdf_after_end", 3, 0.85, f"{len(data) - end - 5} bytes"))
    elif kind == "gzip" and len(data) > 10:
        flags = data[3]
        for bit, what in ((4, "extra field"), (16, "comment")):
            if flags & bit:
                out.append(("gzip_field", 3, 0.8, what))
    elif kind == "sqlite" and len(data) >= 100:
        page = struct.unpack(">H", data[16:18])[0]
        page = 65536 if page == 1 else page
        pages, free = struct.unpack(">I", data[28:32])[0], struct.unpack(">I", data[36:40])[0]
        if free:
            out.append(("sqlite_free_pages", 2, 0.6, f"{free} free pages"))
        if page and len(data) > page * pages > 0:
            out.append(("sqlite_trailing", 3, 0.85, f"{len(data) - page * pages} bytes after the last page"))
    elif kind == "midi" and len(data) > 14:
        at = 8 + struct.unpack(">I", data[4:8])[0]
        while data[at : at + 4] == b"MTrk" and at + 8 <= len(data):
            size = struct.unpack(">I", data[at + 4 : at + 8])[0]
            exclusive = data.count(b"\xf0", at + 8, at + 8 + size)
            if exclusive:
                out.append(("midi_exclusive", 2, 0.6, f"{exclusive} system-exclusive events"))
            at += 8 + size
        if len(data) - at > 10:
            out.append(("midi_trailing", 3, 0.85, f"{len(data) - at} bytes"))
    elif kind == "pcap" and len(data) >= 24:
        at = 24
        while at + 16 <= len(data) and at + 16 + struct.unpack("<I", data[at + 8 : at + 12])[0] <= len(data):
            at += 16 + struct.unpack("<I", data[at + 8 : at + 12])[0]
        if len(data) - at > 10:
            out.append(("pcap_trailing", 3, 0.8, f"{len(data) - at} bytes after the last packet"))
    elif kind == "rtf":
        if b"\\objdata" in data:
            out.append(("rtf_object", 3, 0.8, f"{data.count(b'objdata')} embedded objects"))
        if (end := data.rfind(b"}")) >= 0 and len(data) - end - 1 > 10:
            out.append(("rtf_trailing", 3, 0.85, f"{len(data) - end - 1} bytes after the document"))
    elif kind == "tar":
        at = 0
        while at + 512 <= len(data) and data[at : at + 512].strip(b"\0"):
            at += 512 + -(-int(data[at + 124 : at + 136].strip(b"\0 ") or b"0", 8) // 512) * 512
        if data[at:].strip(b"\0"):
            out.append(("tar_trailing", 3, 0.85, f"{len(data[at:].strip(bytes(1)))} bytes after the last member"))
    elif kind == "riff" and len(data) > 44:
        chunks, rest = wav_chunks(data)
        if rest > 10:
            out.append(("wav_trailing", 3, 0.85, f"{rest} bytes"))
        for c, d in chunks:
            if c not in ("fmt ", "data", "LIST", "fact", "cue ", "smpl", "bext") and len(d) > 100:
                out.append(("wav_private_chunk", 3, 0.7, f"{c!r}, {len(d)} bytes"))
        form = dict(chunks)
        if "fmt " in form and "data" in form and struct.unpack("<H", form["fmt "][14:16])[0] == 16:
            s = np.frombuffer(form["data"][: len(form["data"]) // 2 * 2], "<i2") & 1
            if len(s) > 2000:
                same = float((s[1:] == s[:-1]).mean())
                if abs(same - 0.5) < 0.01 and len(np.unique(np.frombuffer(form["data"][: len(form["data"]) // 2 * 2], "<i2"))) > 24:
                    out.append(("wav_lsb", 2, 0.6, f"lag-one agreement {same:.3f}"))
    return out


def scan_binary(files: DataFrame, most_bytes: int = 50 * 1024 * 1024) -> DataFrame:
    """Findings of (path, content) rows, as Spark's ``binaryFile`` source gives them. Larger files get one finding and are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *x) for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if data for x in findings_of(data)]
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "detector", "severity", "confidence", "evidence"])

    small = files.filter(F.octet_length("content") <= most_bytes).select("path", "content").mapInArrow(run, FOUND)
    large = files.filter(F.octet_length("content") > most_bytes).select("path", F.lit("oversized").alias("detector"), F.lit(1).alias("severity"), F.lit(1.0).alias("confidence"), F.octet_length("content").cast("string").alias("evidence"))
    return small.unionByName(large)


def image_statistics(files: DataFrame) -> DataFrame:
    """Findings from the pixels of the PNG files among (path, content) rows, channel by channel; other files and formats give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pixels = png_pixels(png_chunks(data)[0])
                rows += [(p, *x) for x in statistics(pixels)] if pixels is not None else []
            kinds = (pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["path", "detector", "severity", "confidence", "evidence"])

    return files.filter(F.startswith("content", F.lit(SIGNATURES["png"]))).select("path", "content").mapInArrow(run, FOUND)


def clean_wav(data: bytes, seed: int = 0) -> bytes:
    """A minimal copy: format and samples only, lowest bits drawn anew."""
    form = dict(wav_chunks(data)[0])
    samples = np.frombuffer(form["data"][: len(form["data"]) // 2 * 2], "<i2")
    bits = np.random.default_rng(seed).integers(0, 2, len(samples), dtype=np.int16)
    body = ((samples & ~np.int16(1)) | bits).astype("<i2").tobytes()
    fmt = form["fmt "]
    return b"RIFF" + struct.pack("<I", 4 + 8 + len(fmt) + 8 + len(body)) + b"WAVEfmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(body)) + body


def clean_png(data: bytes, seed: int = 0) -> bytes | None:
    """Pixels only, lowest bits drawn anew, written without filters; None for formats the reader does not know."""
    chunks, _ = png_chunks(data)
    pixels = png_pixels(chunks)
    if pixels is None:
        return None
    noise = np.random.default_rng(seed).integers(0, 2, pixels.shape, dtype=np.uint8)
    return write_png((pixels & 0xFE) | noise, dict(chunks[:1])["IHDR"])


def write_png(pixels: np.ndarray, head: bytes | None = None) -> bytes:
    """A PNG file of (height, width, channels) bytes, without filters."""
    h, w, ch = pixels.shape
    head = head or struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[ch], 0, 0, 0)
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, -1)], 1).tobytes()
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return SIGNATURES["png"] + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def write_wav(samples: np.ndarray) -> bytes:
    """A WAV file of 16-bit samples, one channel."""
    body = samples.astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 16000, 2, 16) + b"data" + struct.pack("<I", len(body)) + body
