"""Language identification by interpolated Kneser-Ney character models.

Spark counts the character 4-grams of every labelled training text per language. From the
counts each language gets an interpolated Kneser-Ney model; all models lie in sorted arrays of
gram codes, one column of log probabilities per language. A text gets the language of lowest
cross-entropy per character; it is rejected if that is more than its language explains.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import batches, carried, column, mixed, ordinary, schema_of

#: Symbols: 0 is everything but letters, each letter is its own code point. Codes of three symbols
#: have 63 bits and are exact, 4-grams are told apart by 64-bit hashes.
BITS, ORDER = 21, 4
#: Kneser-Ney's last resort: every symbol as one of so many.
KINDS = 64
UNKNOWN = "und"
#: Standard deviations of a text's mean that are not yet a reason to reject it.
DEVIATIONS = 6.0
#: How fast the score falls where a text fits no language.
STEEP = 8.0

RESULT = {"lang_pred": "string", "score": "double", "cross_entropy": "double", "accepted": "boolean"}


@lru_cache(1)
def _symbols() -> np.ndarray:
    table = np.zeros(0x110000, np.uint32)
    letters = np.array([c for c in range(0x110000) if chr(c).isalpha()], np.uint32)
    table[letters] = letters
    return table


def symbols(text: str | None) -> np.ndarray:
    """The text's letters in lower case; each run of other characters is one 0, as are the ends."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    s = np.zeros(len(points) + 2, np.uint32)
    s[1:-1] = _symbols()[points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    return s[keep]


def _low(codes: np.ndarray, n: int) -> np.ndarray:
    """The last ``n`` symbols."""
    return codes & np.uint64((1 << BITS * n) - 1)


def grams(s: np.ndarray) -> np.ndarray:
    """The 4-gram that ends at each symbol after the first 0, as the code of its first three symbols
    and its last; the start is padded with 0."""
    padded = np.concatenate([np.zeros(ORDER - 2, np.uint64), s.astype(np.uint64)])
    n = max(len(s) - 1, 0)
    out = np.zeros((n, 2), np.uint64)
    for k in range(ORDER - 1):
        out[:, 0] = (out[:, 0] << np.uint64(BITS)) | padded[k : k + n]
    out[:, 1] = padded[ORDER - 1 : ORDER - 1 + n]
    return out


def _hashed(codes: np.ndarray) -> np.ndarray:
    return mixed(mixed(codes[:, 0]) + codes[:, 1])


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for part in batches(zip(frame.lang, frame.text, strict=True)):
            by_lang: dict[str, list] = {}
            for lang, text in part:
                by_lang.setdefault(lang, []).append(grams(symbols(text)))
            for lang, found in by_lang.items():
                codes = np.concatenate(found)
                _, first, n = np.unique(_hashed(codes), return_index=True, return_counts=True)
                context, last = codes[first].astype(np.int64).T
                yield pd.DataFrame({"lang": lang, "context": context, "symbol": last.astype(np.int32), "n": n})


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_counts(documents: DataFrame) -> DataFrame:
    """lang, context, symbol, n over all documents with a language and a text."""
    return (
        documents.select("lang", "text")
        .filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
        .mapInPandas(_count, "lang string, context long, symbol int, n long")
        .groupBy("lang", "context", "symbol")
        .agg(F.sum("n").alias("n"))
    )


class _Order:
    """Grams of one order and language: sorted codes with counts, contexts with totals and weights.
    Below the highest order a gram counts as often as it ends a distinct gram one order up, the
    Kneser-Ney continuation count."""

    def __init__(self, codes: np.ndarray, n: np.ndarray, contexts: np.ndarray):
        order = np.argsort(codes)
        self.codes, self.n, self.d = codes[order], n[order], _discount(n)
        self.contexts, at, kinds = np.unique(contexts, return_inverse=True, return_counts=True)
        self.totals = np.bincount(at, n)
        self.weights = self.d * kinds / self.totals

    def p(self, codes: np.ndarray, contexts: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Interpolated with ``lower``, the probabilities one order down."""
        n = _found(self.codes, self.n, codes, 0.0)
        total = _found(self.contexts, self.totals, contexts, 1.0)
        return np.maximum(n - self.d, 0) / total + _found(self.contexts, self.weights, contexts, 1.0) * lower


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, other: float) -> np.ndarray:
    at = np.searchsorted(keys, asked).clip(0, len(keys) - 1)
    return np.where(keys[at] == asked, values[at], other)


class Model:
    """Languages in order; for each order from 4 down to 1 the sorted codes of all grams with a row
    of log probabilities each, and those of all contexts with a row of log weights."""

    def __init__(self, counts: pd.DataFrame):
        self.languages = sorted(counts.lang.unique())
        size = len(self.languages)
        own, orders = [], []
        for lang in self.languages:
            rows = counts[counts.lang == lang]
            codes = rows[["context", "symbol"]].to_numpy(np.uint64)
            own.append((codes, rows.n.to_numpy(np.float64)))
            orders.append([_Order(_hashed(codes), own[-1][1], codes[:, 0])])
            below = _lower(codes)
            for order in range(ORDER - 1, 0, -1):
                below, n = np.unique(below, return_counts=True)
                orders[-1].append(_Order(below, n.astype(np.float64), below >> np.uint64(BITS)))
                below = _low(below, order - 1)
        codes = np.concatenate([c for c, _ in own]) if own else np.zeros((0, 2), np.uint64)
        keys, first = np.unique(_hashed(codes), return_index=True)
        codes = codes[first]
        tables = []
        low = [(keys, codes[:, 0], _lower(codes))]
        for order in range(ORDER - 1, 0, -1):
            below = np.unique(low[-1][2])
            low.append((below, below >> np.uint64(BITS), _low(below, order - 1)))
        p = np.full((1, size), 1.0 / KINDS)
        for k in range(ORDER - 1, -1, -1):
            keys, contexts, lower = low[k]
            rest = p[np.searchsorted(low[k + 1][0], lower)] if k < ORDER - 1 else np.repeat(p, len(keys), axis=0)
            p = np.zeros((len(keys), size))
            known = np.unique(contexts)
            weights = np.zeros((len(known), size), np.float32)
            for j, by_order in enumerate(orders):
                p[:, j] = by_order[k].p(keys, contexts, rest[:, j])
                weights[:, j] = np.log(_found(by_order[k].contexts, by_order[k].weights, known, 1.0))
            tables.append((keys, np.log(p).astype(np.float32), known, weights))
        self.tables = tables[::-1]
        # Calibration from all counts: mean and spread of -log p of a language's own grams, and
        # half the way to the language that its model explains best after it.
        self.mean, self.spread = np.zeros(size), np.zeros(size)
        cross = np.full((size, size), np.log(KINDS))
        for j, (g, n) in enumerate(own):
            cost = -self.tables[0][1][np.searchsorted(self.tables[0][0], _hashed(g))].astype(np.float64)
            share = n / n.sum()
            cross[j] = share @ cost
            self.mean[j] = cross[j, j]
            self.spread[j] = np.sqrt(max(share @ (cost[:, j] - self.mean[j]) ** 2, 0))
        other = cross + np.where(np.eye(size, dtype=bool), np.inf, 0)
        nearest = np.minimum(other.min(axis=0, initial=np.inf), np.log(KINDS))
        self.slack = np.maximum(nearest - self.mean, 0) / 2

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """-log p of each gram, a column per language: from the highest order that any language has
        the gram of, times the weights of the contexts above it."""
        out = np.zeros((len(codes), len(self.languages)), np.float32)
        left, key, context, lower = np.arange(len(codes)), _hashed(codes), codes[:, 0], _lower(codes)
        for order, (keys, logs, known, weights) in zip(range(ORDER, 0, -1), self.tables, strict=True):
            at = np.searchsorted(keys, key).clip(0, len(keys) - 1)
            hit = keys[at] == key
            out[left[hit]] -= logs[at[hit]]
            left, context, key = left[~hit], context[~hit], lower[~hit]
            if not len(left):
                return out
            at = np.searchsorted(known, context).clip(0, len(known) - 1)
            seen = known[at] == context
            out[left[seen]] -= weights[at[seen]]
            context, lower = key >> np.uint64(BITS), _low(key, max(order - 2, 0))
        out[left] += np.float32(np.log(KINDS))
        return out

    def judge(self, texts: list[str | None]) -> list[tuple]:
        """lang_pred, score, cross_entropy, accepted of each text."""
        codes = [grams(symbols(t)) for t in texts]
        sizes = np.array([len(c) for c in codes], np.int64)
        if not self.languages or not sizes.sum():
            return [(UNKNOWN, 0.0, None, False)] * len(texts)
        full = np.flatnonzero(sizes)
        starts = np.r_[0, np.cumsum(sizes[full])[:-1]]
        sums = np.add.reduceat(self.costs(np.concatenate([codes[i] for i in full])), starts, axis=0, dtype=np.float64)
        out: list[tuple] = [(UNKNOWN, 0.0, None, False)] * len(texts)
        for row, i in enumerate(full):
            n, total = sizes[i], sums[row]
            best = int(np.argmin(total))
            share = 1.0 / np.exp(np.maximum(total[best] - total, -700.0)).sum()
            entropy = total[best] / n
            room = DEVIATIONS * self.spread[best] / np.sqrt(n) + self.slack[best]
            limit = self.mean[best] + room
            # The share among the languages, times how well the text fits the best one at all: about
            # one at the language's mean, a half at the limit, none far beyond.
            beyond = (entropy - limit) / room if room > 0 else 0.0
            score = share / (1.0 + np.exp(np.clip(STEEP * beyond, -700.0, 700.0)))
            out[i] = (self.languages[best], float(score), float(entropy), bool(entropy <= limit))
        return out


def _discount(n: np.ndarray) -> float:
    one, two = float((n == 1).sum()), float((n == 2).sum())
    return one / (one + 2 * two) if one and two else 0.5


def _lower(codes: np.ndarray) -> np.ndarray:
    """The trigram that ends each 4-gram."""
    return (_low(codes[:, 0], ORDER - 2) << np.uint64(BITS)) | codes[:, 1]


def train(documents: DataFrame) -> Model:
    """A model of every language among ``documents`` (lang, text). The driver receives the
    distinct grams of each language, and every task the tables made of them: they grow with the
    letters and words of the languages, and nothing is left out to bound them."""
    return Model(gram_counts(documents).toPandas())


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """All columns of ``documents`` but clashing ones, then lang_pred, score, cross_entropy and
    accepted. Null texts and texts without a letter get ``und``, score 0 and are not accepted, as
    does every text if no language was learned. Ties go to the first language by name."""
    rows = documents.drop(*[c for c in documents.columns if c.lower() in RESULT])
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_judge(shared, rows.columns), schema_of(rows, **RESULT))


def keep_accepted(documents: DataFrame, model: Model) -> DataFrame:
    """``documents`` without the rows that are not accepted; all columns stay as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    return documents.mapInArrow(_keep(shared), documents.schema)


def _verdicts(shared, batch: pa.RecordBatch) -> list[tuple]:
    return [v for part in batches(enumerate(column(batch, "text"))) for v in shared.value.judge([t for _, t in part])]


def _judge(shared, names: list[str]) -> Callable:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            verdicts = _verdicts(shared, batch)
            kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            new = {n: pa.array([v[i] for v in verdicts], kinds[i]) for i, n in enumerate(RESULT)}
            yield carried(batch, names, **new)

    return run


def _keep(shared) -> Callable:
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            yield batch.filter(pa.array([v[3] for v in _verdicts(shared, batch)], pa.bool_()))

    return run


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, cross_entropy, accepted, one row a document.

    Learns from text and lang of the rows that are not held out; a row with a null id is not
    held out. Repeated rows count and are judged each; empty tables give none."""
    rows = ordinary(documents, ("doc_id", "text", "lang"))
    model = train(rows.filter(~held_out()))
    return predict(rows.select("doc_id", "text"), model).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "accepted"
    )
