"""Repeated word sequences by recompression.

Words are letters of level 0. A round splits the letters by a bit of their name into left and right
ones and joins runs of one letter, and a (run of a) left letter with the right one after it, into a
letter of the next level, named by a hash of what it consists of. Names depend on content only, so
equal word sequences get equal letters wherever they stand, but for those at their ends that may
reach beyond them; each round a window thus keeps its inner letters. After ``LEVELS`` rounds, or
at the last level at which any letter is left, one of them is the window's symbol: the least by
hash, where a letter of k words counts as 4^k hashes, so that mostly long, rare ones are taken.

The names are hashes of 64 bits, alike everywhere without a job that deals them out: a name that
two contents share by chance only makes more windows meet. Stretches are compared by name and 64
further bits, windows by 128 bits.

Neighbouring windows with the same occurrence of a symbol form a stretch. Spark counts symbols over
the corpus; stretches of a symbol that occurs once hold no repeat and are dropped. The others are
compared as wholes: stretches that are equal in all words repeat in all windows. Where one symbol
has several different stretches, those are left that share the words on one side of it: a window
holds half of its other words before its symbol or half of them after it. Of one of each kind of
these the single windows are compared. As the symbol is a function of the window, equal windows
always meet, and the result is exact.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import CACHE_WORDS, carried, fresh, mixed, schema_of, text_hash
from skyloom.storage import drop_stage, stage

WINDOW = 35
#: Rounds; more make longer symbols, and more of them.
LEVELS = 4
#: Words that are parsed at once; longer texts are cut, with their windows overlapping the cut.
CHUNK = 100_000

_U = np.uint64
_RUN, _PAIR, _LANES = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93), (_U(0xA0761D6478BD642F), _U(0xE7037ED1A0B428DB))


class Words(dict):
    """Two independent 64-bit hashes of each word, by number."""

    def __init__(self):
        super().__init__()
        self.lanes = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        both = xxhash.xxh3_128_intdigest(word)
        self.lanes[0].append(both & 0xFFFFFFFFFFFFFFFF)
        self.lanes[1].append(both >> 64)
        number = self[word] = len(self.lanes[0]) - 1
        return number

    def hashes(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if len(self) > CACHE_WORDS:
            self.clear()
            self.lanes = array("Q"), array("Q")
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return tuple(np.array(lane, np.uint64)[at] for lane in self.lanes)


def _least(rank: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the leftmost least ``rank`` in each first..last, by tables of powers of two."""
    size = last - first + 1
    table, out = np.arange(len(rank)), np.zeros(len(first), np.int64)
    power = 1
    while True:
        now = (size >= power) & (size < 2 * power)
        a, b = table[first[now]], table[last[now] - power + 1]
        out[now] = np.where(rank[b] < rank[a], b, a)
        if not (size >= 2 * power).any():
            return out
        a, b = table[:-power], table[power:]
        table = np.where(rank[b] < rank[a], b, a)
        power *= 2


def symbols(names: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Name, level, place and words of the symbol of every window of the letters ``names``."""
    n = len(names) - window + 1
    symbol, level, place, wide = np.zeros(n, np.uint64), np.zeros(n, np.int8), np.zeros(n, np.int64), np.zeros(n, np.int64)
    alive = np.arange(n)
    first, last = alive.copy(), alive + window - 1
    start, words = np.arange(len(names)), np.ones(len(names), np.uint64)
    depth = 0
    while True:
        depth += 1
        right = mixed(names ^ _U(depth * int(_PAIR) & 0xFFFFFFFFFFFFFFFF)) & _U(1) == 1
        cut = np.ones(len(names), bool)
        cut[1:] = (names[1:] != names[:-1]) & (right[:-1] | ~right[1:])
        block = np.cumsum(cut) - 1
        after, before = block[first] + 1, block[last] - 1
        ends = (after > before) | (depth > LEVELS)
        if ends.any():
            rank = mixed(names) >> np.minimum(words * _U(2), _U(62))
            at = _least(rank, first[ends], last[ends])
            symbol[alive[ends]], level[alive[ends]], place[alive[ends]], wide[alive[ends]] = names[at], depth, start[at], words[at]
        alive, first, last = alive[~ends], after[~ends], before[~ends]
        if not len(alive):
            return symbol, level, place, wide
        begin = np.flatnonzero(cut)
        end = np.r_[begin[1:], len(names)]
        rights = np.add.reduceat(right.astype(np.int64), begin)
        lefts = end - begin - rights
        joined = mixed(names[begin] * _RUN + lefts.astype(np.uint64)) * _PAIR + mixed(names[end - 1] * _PAIR + rights.astype(np.uint64))
        names = np.where(end - begin == 1, names[begin], mixed(joined))
        start, words = start[begin], np.add.reduceat(words, begin)


def hashed(lanes: tuple[np.ndarray, ...], start: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """A 64-bit hash by each lane of the ``size`` words from each ``start``: of the two pieces of the
    largest power of two that cover them, whose hashes come from those of half the length."""
    out = []
    for lane, odd in zip(lanes, _LANES, strict=False):
        found, power, now = np.zeros(len(start), np.uint64), 1, mixed(lane ^ odd)
        while True:
            hit = (size >= power) & (size < 2 * power)
            a, b = now[start[hit]], now[start[hit] + size[hit] - power]
            found[hit] = mixed((a * odd + b) * _PAIR + size[hit].astype(np.uint64))
            if not (size >= 2 * power).any():
                break
            now = mixed(now[:-power] * odd + now[power:])
            power *= 2
        out.append(found)
    return out


def chunks(texts: Iterable[bytes | None], window: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """Words of several texts in a row, and for each window start its text, place in the text and
    place in the row. Windows over the border of two texts are left out."""
    held, parts, size = [], [], 0
    for row, text in enumerate(texts):
        words = text.split() if text else []
        for begin in range(0, len(words) - window + 1, CHUNK):
            piece = words[begin : begin + CHUNK + window - 1]
            parts.append((row, begin, size, len(piece) - window + 1))
            held.extend(piece)
            size += len(piece)
            if size >= CHUNK:
                yield held, *_starts(parts)
                held, parts, size = [], [], 0
    if parts:
        yield held, *_starts(parts)


def _starts(parts):
    counts = np.array([p[3] for p in parts])
    row, begin, at = (np.repeat(np.array([p[k] for p in parts]), counts) for k in range(3))
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return row, begin + within, at + within


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _half(lane: np.ndarray, start: np.ndarray, size: np.ndarray, there: np.ndarray) -> pa.Array:
    """32 bits of the hash of the words on one side of a symbol, null where no window has them all."""
    found = np.zeros(len(start), np.int32)
    found[there] = hashed((lane,), start[there], size[there])[0].astype(np.uint32).view(np.int32)
    return pa.array(found, mask=~there)


def _stretches(window: int):
    words = Words()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("body"))
            for held, row, place, at in chunks((x.as_py() for x in texts), window):
                lane = words.hashes(held)[0]
                name, level, symbol_at, wide = (x[at] for x in symbols(lane, window))
                new = np.ones(len(at), bool)
                new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (level[1:] != level[:-1]) | (symbol_at[1:] != symbol_at[:-1])
                begin = np.flatnonzero(new)
                n = np.diff(np.r_[begin, len(at)])
                left, right = symbol_at[begin], symbol_at[begin] + wide[begin]
                half = np.maximum((window - wide[begin] + 1) // 2, 1)
                yield carried(
                    batch, ["doc_id", "text_key"], row[begin].tolist(),
                    symbol=_signed(name[begin]), content=_signed(hashed((lane,), at[begin], n + window - 1)[0]),
                    n=pa.array(n, pa.int32()), first=pa.array(place[begin], pa.int32()),
                    before=_half(lane, left - half, half, left - at[begin] >= half),
                    after=_half(lane, right, half, at[begin] + n - 1 + window - right >= half),
                )

    return run


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.StructArray]:
    """How many structs each row's list holds, and all of them."""
    lists = batch.column(batch.schema.get_field_index(name))
    return lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), lists.flatten()


def _windows(window: int):
    words = Words()

    def made(batch, begin, texts, counts, runs):
        """Hashes of the windows of the runs of some texts; ``counts`` says how many runs each has."""
        n, single = runs.field("n").to_numpy(), runs.field("single").to_numpy(zero_copy_only=False)
        text = np.repeat(np.repeat(np.arange(len(texts)), counts), n)
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        first = np.repeat(runs.field("first").to_numpy(), n) + within
        start = np.cumsum([0, *[len(t) for t in texts[:-1]]])
        w = hashed(words.hashes([w for t in texts for w in t]), start[text] + first, np.full(len(first), window))
        return carried(
            batch, ["doc_id", "text_key"], (begin + text).tolist(), w1=_signed(w[0]), w2=_signed(w[1]),
            first=pa.array(first, pa.int32()), single=pa.array(np.repeat(single, n)),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, runs = _flat(batch, "runs")
            edges = np.cumsum([0, *counts])
            texts = batch.column(batch.schema.get_field_index("body"))
            held, size, begin = [], 0, 0
            for k in range(len(counts)):
                held.append(texts[k].as_py().split())
                size += len(held[-1])
                if size >= CHUNK or k == len(counts) - 1:
                    yield made(batch, begin, held, counts[begin : k + 1], runs[edges[begin] : edges[k + 1]])
                    held, size, begin = [], 0, k + 1

    return run


def _keyed(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text_hash().alias("text_key"), F.col("text").cast("string").cast("binary").alias("body"))


def _of_documents(documents: DataFrame, rows: DataFrame, runs: str) -> DataFrame:
    """doc_id, text_key, body and the list of ``runs`` (structs) of the documents that have any."""
    listed = rows.groupBy("doc_id", "text_key").agg(F.collect_set(runs).alias("runs"))
    listed = listed.select(F.col("doc_id").alias("of"), F.col("text_key").alias("of_key"), "runs")
    same = (F.col("text_key") == F.col("of_key")) & F.col("doc_id").eqNullSafe(F.col("of"))
    return _keyed(documents).join(listed, same).select("doc_id", "text_key", "body", "runs")


def repeated_windows(documents: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, text_key, first, last: word numbers of runs that repeated windows cover."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    keyed = _keyed(documents).filter(F.col("body").isNotNull())
    place = f"doc_id {kind}, text_key long"
    schema = f"{place}, symbol long, content long, n int, first int, before int, after int"
    found = keyed.mapInArrow(_stretches(window), schema)
    found = stage(found.withColumn("id", F.monotonically_increasing_id()), "substring-stretches")
    shared = stage(
        found.groupBy("symbol").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("symbol"), "substring-symbols"
    )
    # One column as the key, so that what is dealt by symbol is dealt anew for the sums by class.
    known = found.withColumn("class", F.struct("symbol", "content", "n")).join(shared, "symbol", "left_semi")
    known = stage(known.drop("symbol", "content", "n"), "substring-shared")
    drop_stage(found)
    classes = stage(
        known.groupBy("class").agg(
            F.count(F.lit(1)).alias("copies"), F.min("id").alias("origin"), F.min("before").alias("before"), F.min("after").alias("after")
        ),
        "substring-classes",
    )
    last = F.col("first") + F.col("class.n") + (window - 2)
    whole = known.join(classes.filter("copies > 1").select("class"), "class", "left_semi").select(
        "doc_id", "text_key", "first", last.alias("last")
    )
    # Kinds of stretches that share a symbol and the words on one side of it; one stretch of each.
    sides = F.array(F.struct(F.lit(0).alias("at"), F.col("before").alias("words")), F.struct(F.lit(1).alias("at"), F.col("after").alias("words")))
    sides = classes.select("origin", "copies", "class.symbol", F.explode(sides).alias("side")).filter("side.words IS NOT NULL")
    sides = sides.withColumn("side", F.struct("symbol", "side")).drop("symbol")
    several = stage(sides.groupBy("side").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("side"), "substring-sides")
    origins = sides.join(several, "side", "left_semi").groupBy("origin").agg((F.max("copies") == 1).alias("single"))
    chosen = known.join(origins, known["id"] == origins["origin"]).select(
        "doc_id", "text_key", F.struct("first", "class.n", "single").alias("run")
    )
    windows = stage(
        _of_documents(documents, chosen, "run").mapInArrow(
            _windows(window), f"{place}, w1 long, w2 long, first int, single boolean"
        ),
        "substring-windows",
    ).withColumn("w", F.struct("w1", "w2"))
    again = windows.groupBy("w").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("w")
    single = windows.filter("single").join(again, "w", "left_semi").select(
        "doc_id", "text_key", "first", (F.col("first") + (window - 1)).cast("int").alias("last")
    )
    return whole.unionByName(single)


def _kept(names: list[str], text: str, runs: str, counts: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            texts, words_of, removed = [], [], []
            size, gone = _flat(batch, runs)
            first, last = (gone.field(n).to_numpy() for n in ("first", "last"))
            edges = np.cumsum([0, *size])
            for k, body in enumerate(batch.column(at)):
                words = body.as_py().encode("utf-8", "surrogatepass").split() if body.is_valid else []
                out = words
                if size[k]:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, first[edges[k] : edges[k + 1]], 1)
                    np.add.at(edge, last[edges[k] : edges[k + 1]] + 1, -1)
                    out = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0)]
                texts.append(b" ".join(out))
                words_of.append(len(words))
                removed.append(len(words) - len(out))
            new = dict(zip(counts, (pa.array(words_of, pa.int64()), pa.array(removed, pa.int64())), strict=True))
            yield carried(batch, names, **new).set_column(at, text, pa.array(texts, pa.binary()).cast(pa.string()))

    return run


def dedup_substrings(
    documents: DataFrame, window: int = WINDOW, n_words: str = "n_words", n_removed: str = "n_removed"
) -> DataFrame:
    """The rows and columns of ``documents`` with the kept words, joined by one space, as ``text``,
    and the number of words and of removed words (columns of these names are replaced).

    A word is a run without ASCII white space, taken as it is. It goes if it lies in ``window``
    consecutive words of its text that stand anywhere else as well, in the same text or another;
    no occurrence is left. Rows that repeat, with equal or null ids, are documents each, so
    that their texts go if they are long enough. Null and empty texts have no words and become
    empty. Texts of any length are taken in pieces of ``CHUNK`` words.
    """
    rows = documents.drop(n_words, n_removed)
    doc, key, runs = (fresh(rows, n) for n in ("run_doc", "run_key", "runs"))
    gone = (
        repeated_windows(documents, window)
        .groupBy("doc_id", "text_key")
        .agg(F.collect_set(F.struct("first", "last")).alias(runs))
        .select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), runs)
    )
    same = (text_hash() == F.col(key)) & F.col("doc_id").eqNullSafe(F.col(doc))
    marked = rows.join(gone, same, "left").select(*rows.columns, runs)
    schema = schema_of(rows, **{n_words: "long", n_removed: "long"})
    return marked.mapInArrow(_kept(rows.columns, "text", runs, (n_words, n_removed)), schema)
