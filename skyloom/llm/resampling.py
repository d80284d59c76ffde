"""Target-distribution importance resampling.

Runs of words fall into hashed buckets. A bucket's gain is how much likelier the target texts make
it than the corpus does; a document's weight is the mean gain of its features, looked up in an
array of ``BUCKETS`` numbers. The weight plus Gumbel noise, fixed by the id, is its score; the
highest scores are drawn. Scores are stored once; the cutoff is found by bisection, each step an
exact count over the stored scores, then over the ids (and rows) tied at it. Only what is drawn
is sorted, by ranges, for its ranks.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import carried, column, fresh, text_hash
from skyloom.storage import stage

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Thresholds counted by one job of the bisection.
CUTS = 15
_NO_ID = -(2**63)

_LOWER = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def features(text: bytes | None, buckets: int, longest: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``longest`` words. The checksum of a
    run is that of the run without its last word, continued."""
    words = text.translate(_LOWER).split() if text else []
    sums = list(map(zlib.crc32, words))
    out = [sums]
    if longest > 1 and len(words) > 1:
        spaced = [b" " + w for w in words]
        for k in range(1, min(longest, len(words))):
            sums = list(map(zlib.crc32, spaced[k:], sums))
            out.append(sums)
    found = np.fromiter((s for part in out for s in part), np.uint32, sum(map(len, out)))
    return len(words), (found % np.uint32(buckets)).astype(np.int64)


def _counts(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            held, size = [], 0
            for text in column(batch, "body"):
                held.append(features(text, buckets, longest)[1])
                size += len(held[-1])
                if size > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
            if held:
                total += np.bincount(np.concatenate(held), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How often each bucket occurs in all texts; a task sends at most a row for each bucket."""
    counted = texts.select(F.col("text").cast("string").cast("binary").alias("body")).mapInArrow(
        _counts(buckets, longest), "bucket int, n long"
    )
    out = np.zeros(buckets, np.int64)
    for row in counted.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of target to corpus share) of each bucket, with one added to each count."""
    all_s, all_t, size = int(corpus.sum()), int(target.sum()), len(corpus)
    pairs = zip(target.tolist(), corpus.tolist(), strict=True)
    ratios = (float(t + 1) * float(all_s + size) / (float(s + 1) * float(all_t + size)) for t, s in pairs)
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def _weights(gain: np.ndarray, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, weights = [], [], []
            for text in column(batch, "body"):
                n, found = features(text, len(gain), longest)
                words.append(n)
                sizes.append(len(found))
                weights.append(int(gain[found].sum()) // len(found) if len(found) else 0)
            new = dict(n_words=words, n_features=sizes, weight=weights)
            yield carried(batch, ["doc_id", "text_key"], **{k: pa.array(v, pa.int64()) for k, v in new.items()})

    return run


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of seed and id."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def scored(documents: DataFrame, gain: np.ndarray, longest: int = LONGEST, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, n_words, n_features, weight, score of each document, stored, with ``row``,
    a number that tells equal rows apart."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    body = F.col("text").cast("string")
    keyed = documents.select("doc_id", text_hash().alias("text_key"), body.cast("binary").alias("body"))
    schema = f"doc_id {kind}, text_key long, n_words long, n_features long, weight long"
    weighed = keyed.mapInArrow(_weights(gain, longest), schema)
    return stage(
        weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).withColumn(
            "row", F.monotonically_increasing_id()
        ),
        "resampling-scores",
    )


def kth_smallest(rows: DataFrame, value: str, k: int) -> int:
    """The k-th smallest of a whole-number column: bisection by exact counts."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        cuts = sorted({low + (high - low) * j // (CUTS + 1) for j in range(1, CUTS + 1)} - {high}) or [low]
        counts = rows.agg(*[F.count_if(F.col(value) <= c) for c in cuts]).first()
        reached = next((i for i, n in enumerate(counts) if n >= k), None)
        if reached is None:
            low = cuts[-1] + 1
        else:
            low, high = (cuts[reached - 1] + 1 if reached else low), cuts[reached]
    return low


def drawn(rows: DataFrame, k: int) -> Column:
    """Condition for the ``k`` rows of highest score, ties to the smaller id, then row."""
    at, left = [], k
    names = ["place", "id_key", "row"]
    tied = rows
    for name in names:
        at.append(kth_smallest(tied, name, left))
        now = tied.agg(
            F.count_if(F.col(name) < at[-1]).alias("below"), F.count_if(F.col(name) == at[-1]).alias("equal")
        ).first()
        left -= now.below
        if left == now.equal:
            break
        tied = tied.filter(F.col(name) == at[-1])
    used = names[: len(at)]
    return F.struct(*used) <= F.struct(*[F.lit(x).cast("long").alias(n) for x, n in zip(at, used, strict=True)])


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """The rows with their number from 1 in the order of ``order``: sorted by ranges, then each
    partition is moved on by the counts of those before it."""
    within = F.monotonically_increasing_id()
    sorted_rows = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part_row", within), "resampling-ranks"
    )
    part = F.shiftright("part_row", 33).cast("int")
    counts = sorted_rows.groupBy(part.alias("part")).count().orderBy("part").collect()  # a row per partition
    before = np.cumsum([0, *[r["count"] for r in counts]]).tolist()
    offsets = rows.sparkSession.createDataFrame([(r.part, b) for r, b in zip(counts, before, strict=False)], "part int, before long")
    place = F.col("before") + F.col("part_row").bitwiseAND(F.lit(2**33 - 1)) + 1
    return sorted_rows.withColumn("part", part).join(offsets, "part").withColumn(name, place).select(*rows.columns, name)


def resampling_ranks(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, buckets: int = BUCKETS, longest: int = LONGEST,
    least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, text_key, n_features, weight, score, rank of every document; ``rank`` is null for
    those not drawn. ``percent`` of the documents with ``least_words`` words are drawn.

    Null and empty texts have no features and weight 0. A null id counts as the smallest and
    is hashed as an empty one. Rows that share id and score are told apart by an arbitrary but
    stored number, so that exactly the asked number is drawn. Without target texts all counts
    are those of smoothing. An empty table gives no rows. Other columns are ignored.
    """
    corpus = bucket_counts(documents, buckets, longest)
    gain = gains(corpus, bucket_counts(target, buckets, longest))
    rows = scored(documents, gain, longest, seed)
    rows = rows.withColumn("place", -F.col("score")).withColumn("id_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)))
    out = ["doc_id", "text_key", "n_features", "weight", "score"]
    enough = F.col("n_words") >= least_words
    k = rows.filter(enough).count() * percent // 100
    if not k:
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    chosen = enough & drawn(rows.filter(enough), k)
    ranked = numbered(rows.filter(chosen), ["place", "id_key", "row"], "rank")
    rest = rows.filter(~chosen).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*out, "rank").unionByName(rest.select(*out, "rank"))


def resample(documents: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The drawn rows of ``documents`` with their columns; rows equal in id and text share the
    outcome."""
    ranks = resampling_ranks(documents, target, **parameters).filter(F.col("rank").isNotNull())
    doc, key = (fresh(documents, n) for n in ("drawn_id", "drawn_key"))
    ranks = ranks.select(F.col("doc_id").alias(doc), F.col("text_key").alias(key))
    return documents.join(ranks, F.col("doc_id").eqNullSafe(F.col(doc)) & text_hash().eqNullSafe(F.col(key)), "left_semi")
