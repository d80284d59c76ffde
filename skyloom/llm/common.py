"""Small helpers of the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the vocabulary that a task keeps at once; a full cache is emptied, results stay equal.
CACHE_WORDS = 400_000

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_hash(text: str = "text") -> Column:
    """Tells apart rows that share an id; null for a null text."""
    return F.xxhash64(text)


class Cache(dict):
    """Values of words, made when first asked for; emptied by ``trim`` when large."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        value = self[word] = self.make(word)
        return value

    def trim(self) -> None:
        if len(self) > CACHE_WORDS:
            self.clear()


def word_hashes(limit: int = 8) -> Cache:
    """64-bit hashes of words given as bytes."""
    return Cache(lambda word: xxhash.xxh64_intdigest(word))


def words_of(text: str | None) -> list[bytes]:
    """The maximal runs without ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


# Blocks of scripts that put no space between words (Thai, Lao, Burmese, Khmer, kana, Han).
_BLOCKS = (
    (0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF),
    (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF),
)
#: The same inside a character class, for Python and for Spark.
UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for a, b in _BLOCKS)
_UNSPACED = re.compile(f"[{UNSPACED}]")


def tokens_of(text: str | None) -> list[bytes]:
    """``words_of``, but each character of a script without spaces is a token."""
    if text and not text.isascii() and _UNSPACED.search(text):
        text = _UNSPACED.sub(r" \g<0> ", text)
    return words_of(text)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(words: list[bytes], size: int, cache: Cache) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``size`` words; fewer words make one shingle."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    size = min(size, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - size + 1 + k])
    return np.unique(out)


def batches(rows: Iterator, size: int = 2_000_000) -> Iterator[list]:
    """Cuts (key, text) pairs into lists of about ``size`` characters, so that one batch of
    long texts doesn't multiply in memory."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += len(row[1] or "")
        if chars >= size:
            yield held
            held, chars = [], 0
    if held:
        yield held


def carried(batch: pa.RecordBatch, names: list[str], rows: list[int] | None = None, **new: pa.Array) -> pa.RecordBatch:
    """Columns of an Arrow batch (its rows in the given order, if any) beside new ones. Arrow
    keeps 64-bit ids exact where a column holds nulls; pandas would make them doubles."""
    old = [batch.column(batch.schema.get_field_index(n)) for n in names]
    if rows is not None:
        old = [c.take(pa.array(rows, pa.int64())) for c in old]
    return pa.RecordBatch.from_arrays([*old, *new.values()], names=[*names, *new])


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def schema_of(df: DataFrame, **new: str) -> str:
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return ", ".join(fields + [f"`{n}` {t}" for n, t in new.items()])


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ordinary(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Only the named columns, so that others may have any name; a missing one is null."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(f"`{have[c.lower()]}`").alias(c) if c.lower() in have else F.lit(None).alias(c) for c in columns])
