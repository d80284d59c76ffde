"""Near duplicates by an inverted join over MinHash signature coordinates.

1. Documents of equal shingle sets are one class, so that copies meet only once.
2. Every class has a signature of ``COORDINATES`` MinHash values; each (coordinate, value) pair is
   a token. Classes that link share at least ``collisions(...)`` of their tokens but for a chance
   of 1e-9 a pair, hence at least one of the rarest COORDINATES - collisions + 1 of each (prefix
   filter). Only these are posted; the rest is skipped.
3. The classes under a token are a list. Its hub, the class whose tokens are most common, is
   compared with each of the others on full shingle sets: pairs as many as postings. Hub and
   list are a cell; every candidate pair lies in a cell.
4. Components of these links are formed. A cell whose members are all in one component is done.
   In any other, members are put in order of their distance to the hub and cut into blocks of
   bounded size; pairs of blocks are compared unless the triangle inequality of the Jaccard
   distance or a common component makes it needless. A comparison yields only links that join
   components, at most as many as it has members.
5. The components of all links are the answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import md5
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import (
    batches,
    carried,
    column,
    fresh,
    mixed,
    ordinary,
    schema_of,
    shingles,
    text_hash,
    word_hashes,
    words_of,
)
from skyloom.llm.components import components
from skyloom.storage import stage

COORDINATES = 40
MISSED = 1e-9
#: Members of a block of a mixed cell; a task compares two blocks.
BLOCK = 512
#: A character of a word: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]"


@lru_cache
def collisions(percent: int) -> int:
    """The most equal coordinates that a pair at the similarity has but for the chance MISSED."""
    p, tail = percent / 100, 0.0
    for m in range(COORDINATES):
        tail += comb(COORDINATES, m) * p**m * (1 - p) ** (COORDINATES - m)
        if tail > MISSED:
            return max(1, m)
    return COORDINATES


def signature(h: np.ndarray) -> np.ndarray:
    """A token for each coordinate and smallest value, as signed 64-bit numbers."""
    keys = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        part = h[at : at + 4096, None] ^ keys
        part *= keys | np.uint64(1)
        part ^= part >> np.uint64(32)
        part *= np.uint64(0xD6E8FEB86659FD93)
        np.minimum(least, part.min(axis=0), out=least)
    return mixed(least + keys).view(np.int64)


def _describe(size: int):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_hashes()
        for batch in found:
            sizes, nodes, tokens = [], [], []
            for text in column(batch, "text"):
                h = shingles(words_of(text), size, cache)
                sizes.append(len(h))
                nodes.append(md5(h.tobytes()).digest() if len(h) else None)
                tokens.append(signature(h) if len(h) else None)
                cache.trim()
            yield carried(
                batch,
                ["doc_id", "text_key"],
                n_shingles=pa.array(sizes, pa.int64()),
                node=pa.array(nodes, pa.binary()),
                tokens=pa.array(tokens, pa.list_(pa.int64())),
            )

    return run


def _sets(size: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache = word_hashes()
        for frame in frames:
            for part in batches(zip(frame.node, frame.text, strict=True)):
                sets = [shingles(words_of(t), size, cache).view(np.int64) for _, t in part]
                cache.trim()
                yield pd.DataFrame({"node": [n for n, _ in part], "shingles": sets})

    return run


def describe(documents: DataFrame, size: int) -> DataFrame:
    """doc_id, text_key, n_shingles, node (digest of the shingle set), tokens. Stored."""
    rows = ordinary(documents, ("doc_id", "text")).withColumn("text_key", text_hash())
    schema = schema_of(rows.select("doc_id", "text_key"), n_shingles="long", node="binary", tokens="array<long>")
    return stage(rows.mapInArrow(_describe(size), schema), "signatures")


def stars(classes: DataFrame, percent: int) -> DataFrame:
    """hub, member: the pairs of each token's hub and list, each pair once. Stored."""
    prefix = COORDINATES - collisions(percent) + 1
    tokens = classes.select("node", F.explode("tokens").alias("token"))
    common = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Only shared tokens are weighed; those that a class has alone come first in its prefix.
    weighed = tokens.join(common, "token").groupBy("node").agg(
        F.sort_array(F.collect_list(F.struct("n", "token"))).alias("shared"),
        F.sum(F.log2("n")).alias("weight"),
    )
    alone = F.lit(COORDINATES) - F.size("shared")
    posted = weighed.filter(alone < prefix).select(
        "node", "weight", F.explode(F.slice("shared", F.lit(1), F.lit(prefix) - alone)).alias("posting")
    ).select("node", F.struct("weight", "node").alias("place"), F.col("posting.token").alias("token"))
    posted = stage(posted, "postings")
    hubs = posted.groupBy("token").agg(F.max("place").alias("top"), F.min("place").alias("low")).filter("top != low")
    pairs = (
        posted.join(hubs.select("token", F.col("top.node").alias("hub")), "token")
        .filter("hub != node")
        .select("hub", F.col("node").alias("member"))
    )
    return stage(pairs.distinct(), "stars")


def _linked(percent: int, both="both", n="n", other="other_n"):
    return F.col(both) * 100 >= (F.col(n) + F.col(other) - F.col(both)) * percent


def _block_links(percent: int):
    """Links within a pair of blocks that join components, from an index of shingles."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["distance", "node"], ignore_index=True)
        sizes = frame["shingles"].map(len).to_numpy()
        owner = np.repeat(np.arange(len(frame)), sizes)
        values, index = np.unique(np.concatenate(frame["shingles"].to_numpy()), return_inverse=True)
        order = np.argsort(index, kind="stable")
        listed, starts = owner[order], np.r_[0, np.cumsum(np.bincount(index, minlength=len(values)))]
        stops = np.r_[0, np.cumsum(sizes)]
        part = pd.factorize(frame["root"])[0]
        found = []
        for a in range(len(frame)):
            if (part == part[a]).all():
                break
            own = index[stops[a] : stops[a + 1]]
            counts = starts[own + 1] - starts[own]
            skip = np.repeat(starts[own] - np.r_[0, np.cumsum(counts)[:-1]], counts)
            both = np.bincount(listed[np.arange(counts.sum()) + skip], minlength=len(frame))
            similar = both * 100 >= (sizes[a] + sizes - both) * percent
            similar[: a + 1] = False
            for b in np.flatnonzero(similar & (part != part[a])):
                if part[b] != part[a]:
                    found.append((frame["node"][a], frame["node"][b]))
                    part[part == part[b]] = part[a]
        return pd.DataFrame(found, columns=["u", "v"])

    return run


def links(documents: DataFrame, described: DataFrame, size: int, percent: int) -> DataFrame | None:
    """u, v: links between nodes that hold all links together; their components are right."""
    place = F.struct("doc_id", "text_key")
    classes = (
        described.filter("n_shingles > 0")
        .groupBy("node")
        .agg(F.min(F.struct(place.alias("place"), "tokens", "n_shingles")).alias("first"))
        .select("node", "first.place", "first.tokens", F.col("first.n_shingles").alias("n"))
    )
    classes = stage(classes, "classes")
    pairs = stars(classes, percent)

    # Shingle sets of the classes in pairs, from one text each.
    wanted = pairs.select(F.explode(F.array("hub", "member")).alias("node")).distinct()
    chosen = classes.join(wanted, "node", "left_semi").select(
        "node", F.col("place.doc_id").alias("chosen_id"), F.col("place.text_key").alias("chosen_key")
    )
    rows = ordinary(documents, ("doc_id", "text")).withColumn("text_key", text_hash())
    texts = rows.join(
        chosen.hint("shuffle_hash"),
        (F.col("text_key") == F.col("chosen_key")) & F.col("doc_id").eqNullSafe(F.col("chosen_id")),
    ).select("node", "text")
    sets = stage(
        texts.mapInPandas(_sets(size), "node binary, shingles array<long>").dropDuplicates(["node"]), "shingles"
    )

    hub_sets = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles"))
    met = (
        pairs.join(sets.select(F.col("node").alias("member"), "shingles"), "member")
        .join(hub_sets, "hub")
        .select(
            "hub",
            "member",
            F.size("shingles").cast("long").alias("n"),
            F.size("hub_shingles").cast("long").alias("other_n"),
            F.size(F.array_intersect("shingles", "hub_shingles")).cast("long").alias("both"),
        )
    )
    met = stage(met, "stars-met")
    star_links = met.filter(_linked(percent)).select(F.col("hub").alias("u"), F.col("member").alias("v"))
    star_links = stage(star_links, "star-links")
    more = cell_links(met, sets, components(star_links), percent)
    return star_links.unionByName(more)


def cell_links(met: DataFrame, sets: DataFrame, found: DataFrame, percent: int) -> DataFrame:
    """Links between members of mixed cells."""
    reach = 1 - percent / 100
    distance = 1 - F.col("both") / (F.col("n") + F.col("other_n") - F.col("both"))
    members = met.select("hub", F.col("member").alias("node"), "n", distance.alias("distance")).unionByName(
        met.select("hub", F.col("hub").alias("node"), F.col("other_n").alias("n"), F.lit(0.0).alias("distance")).distinct()
    )
    members = members.join(found, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("n")
    members = stage(members, "cell-members")
    # Sums by hub and step are stored before they meet the members again: a join with a sum that is
    # already dealt by its key can't split a hub that holds many members, one of two scans can.
    mixed_cells = (
        members.groupBy("hub")
        .agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("cell_size"))
        .filter("a != b and cell_size > 2")
        .select("hub", "cell_size")
    )
    members = members.join(stage(mixed_cells, "mixed-cells"), "hub")
    # Blocks along the distance: equal steps of it, as many as the cell has blocks but no finer
    # than a twentieth, then parts of bounded size of a step by hash.
    steps = F.least(F.lit(20), F.ceil(F.col("cell_size") / BLOCK))
    counted = members.withColumn(
        "step", F.floor(F.least("distance", F.lit(1 - 1e-9)) * steps).cast("int")
    ).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(1 << 20)).cast("int"))
    sizes = counted.groupBy("hub", "step").agg(F.count(F.lit(1)).alias("in_step"))
    parts = F.ceil(F.col("in_step") / BLOCK).cast("int")
    sizes = stage(sizes.select("hub", "step", parts.alias("parts")), "cell-steps")
    blocked = counted.join(sizes, ["hub", "step"]).withColumn("part", F.col("salt") % F.col("parts"))
    blocks = stage(
        blocked.groupBy("hub", "step", "part").agg(
            F.min("root").alias("root_a"),
            F.max("root").alias("root_b"),
            F.min("distance").alias("near"),
            F.max("distance").alias("far"),
        ),
        "cell-blocks",
    )
    left = blocks.select("hub", *[F.col(c).alias(f"l_{c}") for c in blocks.columns if c != "hub"])
    right = blocks.select("hub", *[F.col(c).alias(f"r_{c}") for c in blocks.columns if c != "hub"])
    meetings = left.join(right, "hub").filter(
        (F.struct("l_step", "l_part") <= F.struct("r_step", "r_part"))
        & (F.col("r_near") - F.col("l_far") <= reach + 1e-9)
        & (F.col("l_near") - F.col("r_far") <= reach + 1e-9)
        & ((F.col("l_root_a") != F.col("l_root_b")) | (F.col("l_root_a") != F.col("r_root_a")) | (F.col("r_root_a") != F.col("r_root_b")))
    )
    sides = meetings.select(
        "hub",
        F.concat_ws("/", "l_step", "l_part", "r_step", "r_part").alias("meeting"),
        F.explode(
            F.array_distinct(
                F.array(
                    F.struct(F.col("l_step").alias("step"), F.col("l_part").alias("part")),
                    F.struct(F.col("r_step").alias("step"), F.col("r_part").alias("part")),
                )
            )
        ).alias("side"),
    ).select("hub", "meeting", "side.step", "side.part")
    seated = (
        blocked.select("hub", "step", "part", "node", "root", "distance")
        .join(sides, ["hub", "step", "part"])
        .join(sets, "node")
        .select("hub", "meeting", "node", "root", "distance", "shingles")
    )
    return seated.groupBy("hub", "meeting").applyInPandas(_block_links(percent), "u binary, v binary")


def _judged(documents: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, text_key, n_shingles, root (null without words), component_id."""
    described = describe(documents, size)
    found = components(links(documents, described, size, percent))
    smallest = described.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    rooted = smallest.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return described.join(stage(named.drop("least"), "components"), "node", "left").select(
        "doc_id", "text_key", "n_shingles", "root", component.alias("component_id")
    )


def near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``documents``.

    A document's set are its distinct shingles of ``size`` words (runs without ASCII white space,
    A-Z lower-cased); with fewer words the whole sequence is one. Documents are linked if their
    sets' intersection is at least ``percent`` % of the union. component_id is the smallest
    doc_id that a document reaches, kept tells whether it is its own. Null texts, empty texts and
    texts without words are linked with nothing. A null doc_id is a component_id only where the
    whole component has no other; it isn't kept. Repeated rows are copies of each other. An empty
    table gives no rows; other columns are ignored.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return _judged(documents, size, percent).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def drop_near_duplicates(documents: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, that of smallest doc_id (nulls last), then text hash; rows
    equal in both are copies, of which one stays. Rows without words all stay. All columns stay."""
    judged = stage(_judged(documents, size, percent), "judged")
    chosen_doc, chosen_key, n_copies = (fresh(documents, n) for n in ("chosen_doc", "chosen_key", "copies"))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_key")
    firsts = (
        judged.filter("n_shingles > 0")
        .groupBy("root")
        .agg(F.min(order).alias("first"))
        .select(F.col("first.doc_id").alias(chosen_doc), F.col("first.text_key").alias(chosen_key))
    )
    copies = judged.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias(n_copies))
    chosen = stage(
        firsts.join(
            copies, F.col(chosen_doc).eqNullSafe(F.col("doc_id")) & (F.col(chosen_key) == F.col("text_key"))
        ).select(chosen_doc, chosen_key, n_copies),
        "chosen",
    )
    mine, key = documents.columns, fresh(documents, "row_key")
    keyed = documents.withColumn(key, text_hash())
    same = (F.col(key) == F.col(chosen_key)) & F.col("doc_id").eqNullSafe(F.col(chosen_doc))
    worded = keyed.filter(F.col("text").rlike(WORD))
    single = worded.join(chosen.filter(f"`{n_copies}` = 1"), same, "left_semi")
    repeated = worded.join(chosen.filter(f"`{n_copies}` > 1"), same, "left_semi").dropDuplicates(["doc_id", key])
    wordless = keyed.filter(~F.coalesce(F.col("text").rlike(WORD), F.lit(False)))
    return single.unionByName(repeated).unionByName(wordless).select(*mine)
