"""What the pair operators share: classes of equal texts, verification of candidate pairs, output of pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from veilscan.llm.kernels import BlockCounter, fresh_rows, jaccard, slices, text_class, word_hashes
from veilscan.session import Stage, stage

#: Groups of exact copies (and groups of records) beyond this size are given as pairs with their least member.
EXPAND = 1000
LEAST_WORDS = 10


_COUNTS = {"h": pa.int64(), "n": pa.int64(), "texts": pa.int64()}


def read_once(rows: DataFrame, keep: list[str], grams, share: float, name: str, salt: str | None = None, keep_text: bool = False) -> Stage:
    """One pass over the texts: each row of ten words or more with its class_id (equal for equal word sequences) and n_words,
    and, as rows with h not null, block counts of the hashes that ``grams`` makes of a batch's words (see ``BlockCounter``).

    ``salt`` names a small-integer column that separates collections.
    """
    cols = keep + (["text"] if keep_text else [])
    schema = StructType([StructField(f.name, f.dataType) for f in rows.select(*cols).schema]).add("class_id", "long").add("n_words", "integer").add("h", "long").add("n", "long").add("texts", "long")
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = BlockCounter(share)

        def full(given: dict[str, pa.Array], types: dict[str, pa.DataType]) -> pa.RecordBatch:
            n = len(next(iter(given.values())))
            return pa.RecordBatch.from_arrays([given[c] if c in given else pa.nulls(n, types[c]) for c in names], names)

        def counted(reports: list[pa.RecordBatch], types: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
            for r in reports:
                yield full({"h": r.column(0), "n": r.column(1), "texts": r.column(2)}, types)

        types: dict[str, pa.DataType] = {}
        for batch in slices(batches):
            col = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
            types = {c: col(c).type for c in cols} | {"class_id": pa.int64(), "n_words": pa.int32()} | _COUNTS
            flat, sizes = word_hashes(col("text").to_pylist())
            ids = text_class(flat, sizes)
            if salt:
                ids = ids ^ (col(salt).to_numpy(zero_copy_only=False).astype(np.int64) << 56)
            out = full({c: col(c) for c in cols} | {"class_id": pa.array(ids), "n_words": pa.array(sizes.astype(np.int32))}, types)
            yield out.filter(pa.array(sizes >= LEAST_WORDS))
            yield from counted(counter.add(grams(flat, sizes), batch.num_rows), types)
        yield from counted(counter.close(), types)

    return stage(rows.select(*keep, "text").mapInArrow(run, schema), name)


def with_class(rows: DataFrame, text: str) -> DataFrame:
    """(class_id, text) of texts of ten words or more, copies of a task once; the class is equal for equal word sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in slices(batches):
            flat, sizes = word_hashes(batch.column(0).to_pylist())
            ids = text_class(flat, sizes)
            out = pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0)], ["class_id", "text"])
            yield out.filter(pa.array(fresh_rows(ids, done) & (sizes >= LEAST_WORDS)))

    return rows.select(text).mapInArrow(run, "class_id bigint, text string")


def class_texts(rows: DataFrame, text: str, key: Column, name: str) -> DataFrame:
    """(``name``, text), one text for each value that ``key`` makes of class_id; copies of a task fall together before the shuffle.

    Texts are shuffled and sorted by the name once, for the groups and for a join on it.
    """
    return with_class(rows, text).select(key.alias(name), "text").repartition(name).groupBy(name).agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, texts: DataFrame, least: float, k: int = 3) -> DataFrame:
    """Candidate pairs (a, b) of classes whose sets of k consecutive words overlap by ``least`` or more, exactly.

    ``texts`` (class_id, text) are shuffled once and meet the pairs' second ends, then, with that one text a pair, the first.
    """
    met = pairs.join(texts.select(F.col("class_id").alias("b"), F.col("text").alias("tb")), "b")
    met = met.join(texts.select(F.col("class_id").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            share = jaccard(batch.column(2).to_pylist(), batch.column(3).to_pylist(), k)
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(share)], ["a", "b", "overlap"])
            yield out.filter(pa.array(share >= least - 1e-12))

    return met.mapInArrow(run, "a bigint, b bigint, overlap double")
