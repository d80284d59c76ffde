"""Variable-capacity best-fit packing of token sequences.

Documents are cut into pieces of at most the largest permitted length and dealt to shards of
bounded size. A shard takes its pieces from the longest to the shortest; a piece goes to the
open bin with the least room that holds it. If none does, a bin opens, of the permitted length
that costs least per token once filled from the pieces that are left. In the end every bin
shrinks to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import UNSPACED, ordinary
from skyloom.storage import stage

CAPACITIES = (512, 1024, 2048, 4096)
#: What a bin costs besides its length, in tokens.
OVERHEAD = 32
SHARD_PIECES = 4096


class _Left:
    """Pieces not yet placed, as counts by length, to look ahead with."""

    def __init__(self, lengths: list[int]):
        self.count: dict[int, int] = {}
        for n in lengths:
            self.count[n] = self.count.get(n, 0) + 1
        self.sizes = sorted(self.count)

    def take(self, n: int) -> None:
        self.count[n] -= 1
        if not self.count[n]:
            del self.count[n]
            self.sizes.pop(bisect_left(self.sizes, n))

    def filled(self, room: int) -> int:
        """Tokens that the longest fitting pieces, one after another, put into ``room``."""
        used, at = 0, len(self.sizes)
        while at:
            at = bisect_right(self.sizes, room - used, 0, at)
            if at:
                n = self.sizes[at - 1]
                used += n * min(self.count[n], (room - used) // n)
                at -= 1
        return used


def pack(lengths: list[int], capacities=CAPACITIES, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each piece (given from the longest to the shortest), and bin capacities."""
    capacities = sorted(capacities)
    left, rooms, content, sizes = _Left(lengths), [], [], []  # rooms: (room, bin) in order
    bins, offsets = [], []
    for n in lengths:
        left.take(n)
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            fits = [c for c in capacities if c >= n]
            room = min(fits, key=lambda c: ((c + overhead) / (n + left.filled(c - n)), -c))
            b = len(content)
            content.append(0)
            sizes.append(room)
        bins.append(b)
        offsets.append(content[b])
        content[b] += n
        if room > n:
            insort(rooms, (room - n, b))
    return bins, offsets, [next(c for c in capacities if c >= used) for used in content]


def _shard(capacities, overhead):
    def run(table: pa.Table) -> pa.Table:
        n, ordinal, piece = (table.column(c).to_numpy() for c in ("n_tokens", "ordinal", "piece"))
        order = np.lexsort((piece, ordinal, -n))
        bins, offsets, sizes = pack(n[order].tolist(), capacities, overhead)
        first = table.column("shard")[0].as_py() << 32
        out = table.select(["doc_id", "piece", "start", "n_tokens"]).take(pa.array(order))
        for name, values, kind in (
            ("bin_id", [first + b for b in bins], pa.int64()),
            ("offset", offsets, pa.int32()),
            ("capacity", [sizes[b] for b in bins], pa.int32()),
        ):
            out = out.append_column(name, pa.array(values, kind))
        return out

    return run


def token_count(text: str = "text"):
    """Runs without ASCII white space, and each character of a script without spaces; 0 for a null text."""
    one = rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+"
    return F.coalesce(F.regexp_count(F.col(text), F.lit(one)), F.lit(0))


def pack_documents(documents: DataFrame, capacities=CAPACITIES, overhead: int = OVERHEAD) -> DataFrame:
    """doc_id, piece, start, n_tokens, bin_id, offset, capacity: where every piece of every
    document lies. ``start`` is the piece's first token in its document, ``offset`` its first
    token in the bin, ``capacity`` the bin's final length.

    A document without tokens (null, empty or blank text) is one piece of 0 tokens without a bin.
    Repeated rows are packed each; an empty table gives none; other columns are ignored.

    Only ids and lengths are shuffled. They are stored with an ordinal that deals them to the
    shards, so a shard is of bounded size whatever ids repeat, and a task that is run again gets
    the same rows.
    """
    largest = max(capacities)
    lengths = ordinary(documents, ("doc_id", "text")).select("doc_id", token_count().alias("tokens"))
    lengths = stage(lengths.withColumn("ordinal", F.monotonically_increasing_id()), "lengths")
    starts = F.sequence(F.lit(0), F.greatest(F.col("tokens") - 1, F.lit(0)), F.lit(largest))
    pieces = lengths.select("doc_id", "ordinal", "tokens", F.posexplode(starts).alias("piece", "start")).select(
        "doc_id", "piece", "start", F.least(F.col("tokens") - F.col("start"), F.lit(largest)).alias("n_tokens"), "ordinal"
    )
    n = pieces.filter("n_tokens > 0").count()
    shards = max(1, -(-n // SHARD_PIECES))
    kind = lengths.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start int, n_tokens int, bin_id long, offset int, capacity int"
    packed = (
        pieces.filter("n_tokens > 0")
        .withColumn("shard", F.pmod(F.xxhash64("ordinal", "piece"), F.lit(shards)).cast("int"))
        .groupBy("shard")
        .applyInArrow(_shard(tuple(capacities), overhead), schema)
    )
    none = pieces.filter("n_tokens = 0").select(
        "doc_id", "piece", "start", "n_tokens",
        F.lit(None).cast("long").alias("bin_id"), F.lit(None).cast("int").alias("offset"), F.lit(None).cast("int").alias("capacity"),
    )
    return packed.unionByName(none)
