"""Benchmark decontamination by greedy string tiling.

Runs of ``MIN_MATCH`` equal tokens seed the pairs of documents and benchmark items. Each pair is
tiled: the longest matches between unmarked tokens are found by Karp-Rabin hashing and marked,
then shorter ones, down to ``MIN_MATCH``. Tiles may come in any order, so a reordered passage
still covers its item. A document leaks an item whose tokens are covered to ``COVERAGE``. An item
of fewer than ``MIN_MATCH`` tokens is leaked by a document that consists of it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skyloom.llm.common import carried, column, mixed, ordinary, schema_of, tokens_of

MIN_MATCH = 5
COVERAGE = 0.6
#: Tokens of benchmark items that are sent to the tasks at once; more make several rounds.
BLOCK_TOKENS = 2_000_000
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Block:
    """Items of a bounded part of the benchmark with an index of their seeds."""

    def __init__(self, items: list[tuple]):
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple] = []
        self.short: dict[tuple, list] = {}
        hashes, owners = [], []
        for item, text in items:
            words = tokens_of(text)
            if len(words) < MIN_MATCH:
                self.short.setdefault(tuple(words), []).append(item)
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]
            seeds = np.unique(_seeds(np.array(ids, np.uint64)))
            hashes.append(seeds)
            owners.append(np.full(len(seeds), len(self.items)))
            self.items.append((item, ids))
        seeds = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(seeds, kind="stable")
        self.seeds = seeds[order]
        self.owners = (np.concatenate(owners) if owners else np.zeros(0, np.int64))[order]

    def leaks(self, text: str | None, coverage: float) -> list[tuple]:
        """(item, covered share, matched tokens) of each item that the text covers."""
        words = tokens_of(text)
        if len(words) < MIN_MATCH:
            same = self.short.get(tuple(words), ()) if words else ()
            return sorted(((item, 1.0, len(words)) for item in same), key=lambda x: (x[0] is None, x[0]))
        if not len(self.seeds):
            return []
        get = self.vocabulary.get
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        own = _seeds(ids)
        left = np.searchsorted(self.seeds, own, "left")
        hit = np.flatnonzero(self.seeds[left.clip(0, len(self.seeds) - 1)] == own)
        if not len(hit):
            return []
        right = np.searchsorted(self.seeds, own[hit], "right")
        pairs: dict[int, list[int]] = {}
        for at, a, b in zip(hit.tolist(), left[hit].tolist(), right.tolist(), strict=True):
            for owner in self.owners[a:b].tolist():
                pairs.setdefault(owner, []).append(at)
        out = []
        for owner, places in pairs.items():
            item, pattern = self.items[owner]
            if (matched := tile(pattern, _segments(ids, places))) >= coverage * len(pattern):
                out.append((item, matched / len(pattern), matched))
        return sorted(out, key=lambda x: (x[0] is None, x[0]))


def _seeds(ids: np.ndarray) -> np.ndarray:
    n = len(ids) - MIN_MATCH + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(MIN_MATCH):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + ids[k : k + n])
    return out


def _segments(ids: np.ndarray, places: list[int]) -> list[list[int]]:
    """The stretches of the text that seeds cover; every match lies in one."""
    out, first, last = [], places[0], places[0]
    for p in places[1:]:
        if p > last + MIN_MATCH:
            out.append(ids[first : last + MIN_MATCH].tolist())
            first = p
        last = p
    out.append(ids[first : last + MIN_MATCH].tolist())
    return out


def _free_runs(marked: list[bytearray]) -> Iterator[tuple[int, int, int]]:
    """(sequence, start, stop) of the unmarked runs."""
    for s, marks in enumerate(marked):
        at = 0
        while (start := marks.find(0, at)) >= 0:
            at = marks.find(1, start)
            at = len(marks) if at < 0 else at
            yield s, start, at


def _hashes(tokens: list[int], start: int, stop: int, size: int) -> Iterator[tuple[int, int]]:
    """Karp-Rabin: (hash, place) of each run of ``size`` tokens within start..stop."""
    h, high = 0, pow(_BASE, size - 1, _PRIME)
    for i in range(start, stop):
        if i - start >= size:
            h -= tokens[i - size] * high
        h = (h * _BASE + tokens[i]) % _PRIME
        if i - start >= size - 1:
            yield h, i - size + 1


def _matches(pattern, segments, runs_p, runs_s, size: int) -> Iterator[tuple[int, int, int]]:
    """(place in the pattern, segment, place in it) of equal runs of ``size`` unmarked tokens."""
    table: dict[int, list[int]] = {}
    for _, a, b in runs_p:
        for h, p in _hashes(pattern, a, b, size) if b - a >= size else ():
            table.setdefault(h, []).append(p)
    for s, a, b in runs_s if table else ():
        for h, t in _hashes(segments[s], a, b, size) if b - a >= size else ():
            for p in table.get(h, ()):
                if pattern[p : p + size] == segments[s][t : t + size]:
                    yield p, s, t


def tile(pattern: list[int], segments: list[list[int]], least: int = MIN_MATCH) -> int:
    """Number of the pattern's tokens in the tiles of a greedy tiling with the segments.

    Matches of one length are marked in the order of the pattern's places, then of the
    segments'; a match that meets a tile of its own round is left for a shorter length. The next
    length is searched downwards in growing steps, then by halves: a run that matches holds
    shorter ones, so lengths without a match needn't be hashed one by one."""
    marked_p, marked_s = [bytearray(len(pattern))], [bytearray(len(s)) for s in segments]
    size, covered = min(len(pattern), max(map(len, segments))), 0
    while size >= least:
        runs_p, runs_s = list(_free_runs(marked_p)), list(_free_runs(marked_s))
        size = min(size, max((b - a for _, a, b in runs_p), default=0), max((b - a for _, a, b in runs_s), default=0))

        def any_of(n):
            return next(_matches(pattern, segments, runs_p, runs_s, n), None) is not None  # noqa: B023

        none, step = size + 1, 1
        while size >= least and not any_of(size):
            none, size, step = size, max(size - step, least) if size > least else least - 1, step * 2
        if size < least:
            break
        while none - size > 1:
            middle = (size + none) // 2
            size, none = (middle, none) if any_of(middle) else (size, middle)
        for p, s, t in sorted(_matches(pattern, segments, runs_p, runs_s, size)):
            if not any(marked_p[0][p : p + size]) and not any(marked_s[s][t : t + size]):
                marked_p[0][p : p + size] = marked_s[s][t : t + size] = b"\1" * size
                covered += size
        size -= 1
    return covered


def benchmark_blocks(benchmark: DataFrame, block_tokens: int = BLOCK_TOKENS) -> list[DataFrame]:
    """The benchmark cut by a hash of its items into parts of about ``block_tokens`` tokens."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    tokens = items.agg(F.coalesce(F.sum(F.length("text") / 2), F.lit(0))).first()[0]
    n = max(1, -(-int(tokens) // block_tokens))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k) for k in range(n)]


def _load(spark: SparkSession, part: DataFrame):
    return spark.sparkContext.broadcast(Block([tuple(r) for r in part.collect()]))


def _report(shared, coverage: float, item_kind) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(i, leak) for i, t in enumerate(column(batch, "text")) for leak in shared.value.leaks(t, coverage)]
            yield carried(
                batch,
                ["doc_id"],
                [i for i, _ in found],
                item_id=pa.array([leak[0] for _, leak in found], item_kind),
                coverage=pa.array([leak[1] for _, leak in found], pa.float64()),
                matched=pa.array([leak[2] for _, leak in found], pa.int32()),
            )

    return run


def _keep(shared, coverage: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not shared.value.leaks(t, coverage) for t in column(batch, "text")], pa.bool_()))

    return run


def contaminated(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, matched: a row for each document and each item that it leaks.

    Tokens are runs without white space, A-Z lower-cased; each character of a script without spaces
    is one. Null and empty texts leak nothing, and an empty item is not leaked; an item of fewer than
    ``MIN_MATCH`` tokens is leaked by a document of exactly these. Repeated documents give
    repeated rows, repeated items one. An empty table on either side gives no rows.

    The benchmark goes to the tasks in blocks of bounded size, each against all documents in one
    scan without a shuffle; the tiling of a document happens where it was read.
    """
    rows, items = ordinary(documents, ("doc_id", "text")), ordinary(benchmark, ("item_id", "text"))
    item = items.schema["item_id"].dataType
    schema = schema_of(rows.select("doc_id"), item_id=item.simpleString(), coverage="double", matched="int")
    out = None
    for part in benchmark_blocks(items):
        found = rows.mapInArrow(_report(_load(documents.sparkSession, part), coverage, to_arrow_type(item)), schema)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminate(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """``documents`` without the rows that leak an item; all columns stay."""
    for part in benchmark_blocks(ordinary(benchmark, ("item_id", "text"))):
        documents = documents.mapInArrow(_keep(_load(documents.sparkSession, part), coverage), documents.schema)
    return documents
