"""Hidden layers of text: decoded candidates as Columns, transpositions and rarer codecs in one Arrow kernel."""

from __future__ import annotations

import base64
import binascii
import codecs
import quopri
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilscan.functions import catalog as C

_ABC = "abcdefghijklmnopqrstuvwxyz"
ROT13_FROM, ROT13_TO = _ABC + _ABC.upper(), _ABC[13:] + _ABC[:13] + (_ABC[13:] + _ABC[:13]).upper()


def _texts(tokens: Column, kind: str) -> Column:
    """Each token decoded, if it is valid UTF-8 text of six characters or more, nearly all printable."""
    text = F.transform(tokens, lambda x: F.try_validate_utf8(F.try_to_binary(x, F.lit(kind)).cast("string")))
    return F.filter(text, lambda s: s.isNotNull() & (F.length(s) >= 6) & (F.regexp_count(s, F.lit(r"[\x00-\x08\x0E-\x1F\x7F]")) * 7 <= F.length(s)))


def decoded_layers(items: DataFrame) -> DataFrame:
    """(kind, id, method, decoded): base64 and hex runs, rot13, percent-coding and reversal of each text, where they read as text."""
    t = F.col("text")
    b64 = _texts(F.regexp_extract_all(t, F.lit(r"[A-Za-z0-9+/]{20,}={0,2}"), F.lit(0)), "base64")
    hexa = _texts(F.regexp_extract_all(t, F.lit(r"\b(?:[0-9a-fA-F]{2}){20,}\b"), F.lit(0)), "hex")
    percent = F.when(t.rlike("%[0-9A-Fa-f]{2}"), F.array(F.try_url_decode(t))).otherwise(F.array().cast("array<string>"))
    one = lambda m, a: F.transform(a, lambda s: F.struct(F.lit(m).alias("method"), s.alias("decoded")))
    layers = F.concat(one("base64", b64), one("hex", hexa), one("percent", F.filter(percent, lambda s: s.isNotNull())), one("rot13", F.array(F.translate(t, ROT13_FROM, ROT13_TO))), one("reversed", F.array(F.reverse(t))))
    rows = items.filter("text IS NOT NULL AND length(text) > 0").select("kind", "id", F.explode(layers).alias("x"))
    return rows.select("kind", "id", "x.method", "x.decoded")


#: What is decoded again, and how many rounds there are in all.
CODECS, ROUNDS = ("base64", "hex", "percent"), 3


def decoded_rounds(items: DataFrame) -> DataFrame:
    """``decoded_layers``, and what its base64, hex and percent layers hold in turn; the method is that of the last round."""
    out = layers = decoded_layers(items)
    for _ in range(ROUNDS - 1):
        layers = decoded_layers(layers.filter(F.col("method").isin(*CODECS)).select("kind", "id", F.col("decoded").alias("text")))
        out = out.union(layers)
    return out


def encoded_injection(items: DataFrame) -> DataFrame:
    """(kind, id, method, category) of decoded layers, nested ones too, that hold injected instructions."""
    rows = decoded_rounds(items).select("kind", "id", "method", F.explode(F.array_compact(F.array(*[F.when(F.col("decoded").rlike(p), c) for c, p in C.RULES]))).alias("category"))
    return rows.filter(~F.col("method").isin("rot13", "reversed") | F.col("category").isin(*C.CRITICAL)).distinct()


def _shift(text: str, n: int) -> str:
    turned = _ABC[n:] + _ABC[:n]
    return text.translate(str.maketrans(_ABC + _ABC.upper(), turned + turned.upper()))


@lru_cache(maxsize=4096)
def _rail_order(n: int, rails: int) -> np.ndarray:
    at = np.arange(n) % (2 * rails - 2)
    return np.argsort(np.minimum(at, 2 * rails - 2 - at), kind="stable")


@lru_cache(maxsize=4096)
def _column_order(n: int, width: int) -> np.ndarray:
    return np.argsort(np.arange(n) % width, kind="stable")


def _unplaced(text: str, order: np.ndarray) -> str:
    """The text whose characters, taken in this order, are the given ones."""
    given = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.empty_like(given)
    out[order] = given
    return out.tobytes().decode("utf-32-le", "surrogatepass")


def _unrail(text: str, rails: int) -> str:
    return _unplaced(text, _rail_order(len(text), rails))


def _uncolumn(text: str, width: int) -> str:
    return _unplaced(text, _column_order(len(text), width))


#: Stems of which a critical rule needs one at least: what a plain text without them hides is no injection.
STEMS = ("instruction", "rule", "prompt", "guideline", "directive", "constraint", "context", "filter", "polic", "jailbreak", "anything", "unrestricted", "dan")
_STEM = re.compile(r"instruction|rule|prompt|guideline|directive|constraint|context|filter|polic|jailbreak|anything|unrestricted|\bdan\b")
#: By how far a text is shifted back, the stems as they stand in it.
_SHIFTED = [(n, re.compile("|".join(rf"\b{_shift(s, 26 - n)}\b" if s == "dan" else _shift(s, 26 - n) for s in STEMS))) for n in range(1, 26)]
_MIRROR = str.maketrans(_ABC + _ABC.upper(), _ABC[::-1] + _ABC[::-1].upper())
_MIRRORED = re.compile("|".join(rf"\b{s.translate(_MIRROR)}\b" if s == "dan" else s.translate(_MIRROR) for s in STEMS))
_LETTERS = np.frombuffer(bytes(c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ .,;:!?\'\n" for c in range(256)), bool)


def _xored(raw: bytes) -> Iterator[bytes]:
    """The bytes under each single-byte key that leaves nearly nothing but letters, blanks and marks."""
    data = np.frombuffer(raw, np.uint8)
    for key in range(1, 256):
        plain = data ^ key
        if _LETTERS[plain].mean() > 0.9:
            yield plain.tobytes()


def _unuu(text: str) -> Iterator[bytes]:
    for block in re.findall(r"(?m)^begin \d{3} .*\n((?:.+\n)+?)`?\n?end", text):
        try:
            yield b"".join(binascii.a2b_uu(line) for line in block.splitlines())
        except binascii.Error:
            pass


def _bytes_layers(text: str) -> Iterator[tuple[str, bytes]]:
    for token in re.findall(r"\b[A-Z2-7]{16,}={0,6}", text):
        try:
            yield "base32", base64.b32decode(token + "=" * (-len(token) % 8))
        except (ValueError, binascii.Error):
            pass
    for token in re.findall(r"[A-Za-z0-9+/]{20,}={0,2}", text):
        try:
            raw = base64.b64decode(token + "=" * (-len(token) % 4))
        except (ValueError, binascii.Error):
            continue
        try:
            yield "zlib", zlib.decompress(raw)
        except zlib.error:
            yield "base64_rot13", codecs.encode(raw.decode("latin-1"), "rot13").encode()
    for token in re.findall(r"\b(?:[0-9a-fA-F]{2}[ \n]?){12,}\b", text):
        for plain in _xored(bytes.fromhex(re.sub(r"\s", "", token))):
            yield "hex_xor", plain
    numbers = re.findall(r"&#(x?[0-9a-fA-F]+);", text)
    if len(numbers) >= 3:
        yield "entities", unescape(text).encode("utf-8", "surrogatepass")
        yield "entities_joined", "".join(unescape(f"&#{x};") for x in numbers).encode("utf-8", "surrogatepass")
    for plain in _unuu(text):
        yield "uuencode", plain
    if text.count("=") >= 3:
        yield "quoted_printable", quopri.decodestring(text.encode("utf-8", "surrogatepass"))
    for name, codec in (("ascii85", base64.a85decode), ("base85", base64.b85decode)):
        for token in re.findall(r"\S{20,}", text):
            try:
                yield name, codec(token)
            except (ValueError, binascii.Error):
                pass


def heavy_layers(text: str) -> Iterator[tuple[str, str]]:
    """Every reading of a text, whole, that holds a stem of a critical rule: ciphers and codecs."""
    low = text.lower()
    if len(text) >= 12:
        if _MIRRORED.search(low):
            yield "atbash", text.translate(_MIRROR)
        for n, stems in _SHIFTED:
            if stems.search(low):
                yield f"caesar_{n}", _shift(text, n)
        yield "words_reversed", " ".join(text.split()[::-1])
        for n in (2, 3, 4):
            yield f"rail_{n}", _unrail(text, n)
        for n in range(2, 7):
            yield f"columns_{n}", _uncolumn(text, n)
    for name, raw in _bytes_layers(text):
        try:
            yield name, raw.decode("utf-8")
        except UnicodeDecodeError:
            pass


def heavy_injection(items: DataFrame) -> DataFrame:
    """(kind, id, method, category) of ciphered or rarely coded texts that decode to critical instructions."""
    rules = [(c, re.compile(p)) for c, p in C.RULES if c in ("instruction_override", "prompt_reveal", "safety_bypass", "jailbreak_keyword")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for kind, i, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                low = (text or "").lower()
                for method, plain in heavy_layers(text or ""):
                    if plain.lower() != low and _STEM.search(plain.lower()):
                        out += [(kind, i, method, c) for c, p in rules if p.search(plain)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string(), pa.string()))], ["kind", "id", "method", "category"])

    return items.select("kind", F.col("id").cast("bigint").alias("id"), "text").mapInArrow(run, "kind string, id bigint, method string, category string")
