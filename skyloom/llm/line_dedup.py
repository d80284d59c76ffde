"""Repeated runs of lines by winnowing.

A document is its sequence of line hashes. Its windows are the shortest runs of lines with at
least ``min_words`` words, taken forwards from each line and backwards from each line; the
smallest line hash of a window is its fingerprint. A repeated run of that many words holds the
same windows wherever it stands, so that it is guaranteed to share a fingerprint. Fingerprints
that occur once are dropped; the windows of the others are joined on their content, which is
the match grown from its fingerprint to both sides up to the window's ends; overlapping
matches make up the whole repeated run. Every occurrence but the first loses its lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import carried, column, fresh, schema_of, text_hash
from skyloom.storage import stage

MIN_WORDS = 50
_PRIME, _BASE = (1 << 61) - 1, 0x1F3D5B79A3C5E7F1 % ((1 << 61) - 1)


def line_hashes(text: str) -> tuple[list[int], list[int], list[int], list[int]]:
    """Number, two independent hashes and word count of the lines that have words. The first hash
    chooses fingerprints, the second makes contents: together they tell runs apart by 120 bits,
    enough for the windows of a hundred terabytes."""
    at, hashes, others, words = [], [], [], []
    for i, line in enumerate(text.split("\n")):
        found = line.lower().split()
        if found:
            both = xxhash.xxh3_128_intdigest(" ".join(found).encode("utf-8", "surrogatepass"))
            at.append(i)
            hashes.append(both >> 68)
            others.append(both % _PRIME)
            words.append(len(found))
    return at, hashes, others, words


def spans(words: list[int], least: int) -> set[tuple[int, int]]:
    """The shortest runs (first, last) with ``least`` words from each line on and up to each."""
    out = set()
    total, last = 0, -1
    for first in range(len(words)):
        while total < least and last + 1 < len(words):
            last += 1
            total += words[last]
        if total < least:
            break
        out.add((first, last))
        total -= words[first]
    total, first = 0, 0
    for last in range(len(words)):
        total += words[last]
        while total - words[first] >= least:
            total -= words[first]
            first += 1
        if total >= least:
            out.add((first, last))
    return out


def windows_of(text: str, least: int) -> Iterator[tuple[int, int, int, int]]:
    """fingerprint, content hash, first line, last line."""
    at, hashes, others, words = line_hashes(text)
    if sum(words) < least:
        return
    sums, powers = [0], [1]
    for h in others:
        sums.append((sums[-1] * _BASE + h) % _PRIME)
        powers.append(powers[-1] * _BASE % _PRIME)
    for first, last in spans(words, least):
        content = (sums[last + 1] - sums[first] * powers[last + 1 - first]) % _PRIME
        yield min(hashes[first : last + 1]), content ^ ((last - first) & 0xFF), at[first], at[last]


def _windows(least: int):
    names = ("fingerprint", "content", "first", "last")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, w) for i, text in enumerate(column(batch, "text")) for w in windows_of(text, least)]
            new = {n: pa.array([w[k] for _, w in found], kinds[k]) for k, n in enumerate(names)}
            yield carried(batch, ["doc_id", "text_key"], [i for i, _ in found], **new)

    return run


def _cut(names: list[str], text: str, runs: str, removed: str):
    def clean(body, gone):
        if not gone:
            return body, 0
        gone = {i for run in gone for i in range(run["first"], run["last"] + 1)}
        return "\n".join(x for i, x in enumerate(body.split("\n")) if i not in gone), len(gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            done = [clean(t, r) for t, r in zip(column(batch, text), column(batch, runs), strict=True)]
            out = carried(batch, names, **{removed: pa.array([n for _, n in done], pa.int32())})
            yield out.set_column(at, text, pa.array([t for t, _ in done], pa.string()))

    return run


def repeated_runs(documents: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_key, first, last: the lines of every window that occurred before, in the
    order of doc_id (nulls first), text hash and line."""
    keyed = documents.select("doc_id", F.col("text").cast("string").alias("text"), text_hash().alias("text_key")).filter(F.col("text").isNotNull())
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, text_key long, fingerprint long, content long, first int, last int"
    windows = stage(keyed.mapInArrow(_windows(min_words), schema), "line-windows")
    place = F.struct("doc_id", "text_key", "first", "last")
    # One column, so that what is dealt by fingerprint is dealt anew for the sums by window; the
    # fingerprints are stored, so that AQE can split one that a common passage has.
    windows = windows.withColumn("window", F.struct("fingerprint", "content"))
    # Twice somewhere: the smallest place isn't the largest. Both are kept by partial sums.
    shared = stage(
        windows.groupBy("fingerprint")
        .agg(F.min(place).alias("a"), F.max(place).alias("b"))
        .filter("a != b")
        .select("fingerprint"),
        "line-fingerprints",
    )
    candidates = windows.join(shared, "fingerprint", "left_semi")
    origins = stage(
        candidates.groupBy("window")
        .agg(F.min(place).alias("origin"), F.max(place).alias("latest"))
        .filter("origin != latest")
        .select("window", "origin"),
        "line-origins",
    )
    return (
        windows.join(origins, "window")
        .filter(F.col("origin") != place)
        .select("doc_id", "text_key", "first", "last")
    )


def dedup_lines(documents: DataFrame, min_words: int = MIN_WORDS, removed: str = "n_removed") -> DataFrame:
    """The rows and columns of ``documents`` with the cleaned ``text``, and ``removed``, the
    number of lines taken out (a column of that name in the input is replaced).

    A line goes if it lies in a run of whole lines with at least ``min_words`` words that stands
    earlier too: in a document of smaller doc_id (a null id is the smallest; rows of one id go by
    the text's hash) or higher up in the same one. Lines are compared by their words, A-Z and
    other letters in lower case. Blank lines inside a run go with it. Rows equal in doc_id and
    text are one document and share its outcome; null and empty texts stay as they are.
    """
    rows = documents.drop(removed)
    doc, key, runs = (fresh(rows, n) for n in ("run_doc", "run_key", "runs"))
    gone = (
        repeated_runs(documents, min_words)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("first", "last")).alias(runs))
        .select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), runs)
    )
    same = (text_hash() == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc))
    kept = rows.join(gone, same, "left").select(*rows.columns, runs)
    return kept.mapInArrow(_cut(rows.columns, "text", runs, removed), schema_of(rows, **{removed: "int"}))
