"""Near-duplicate classes by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a universe of slots make all signature coordinates: one scatters the hashed shingles over the slots, the other,
shifted circularly by k, gives coordinate k as a minimum.  Equal shingle sets are one vertex.  Documents that share a band's rows are
candidates; links are confirmed on the full sets.

No pairs are emitted within a bucket.  Each member is compared with its bucket's hub (its least vertex), which gives most links.  All
members of one hub's buckets form a group; where a group holds several components, those members outside its largest component are
compared with all members of other components, in blocks of bounded size.  So every candidate pair is either confirmed, refuted, or
known to be connected already.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatica.llm.common import checkpoint, connected_components, has_rows, small_batches
from prismatica.llm.rolling import Rolling, mix, signed
from prismatica.llm.substring_dedup import word_tokens

#: At a similarity of 0.8 a pair shares no band with a probability of (1 - 0.8**6)**46, under one in a million.
ROWS, BANDS = 6, 46
COORDINATES = ROWS * BANDS
SLOTS = 1 << 18
#: Shingles of the queries, and of the members, of one block; a single set may be larger.
QUERY_SHINGLES, GROUP_SHINGLES = 400_000, 2_000_000


@lru_cache(maxsize=1)
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all circular shifts of the second one as rows of one strided view."""
    rng = np.random.default_rng(20_240_601)
    scatter = rng.permutation(SLOTS).astype(np.int64)
    second = rng.permutation(SLOTS).astype(np.uint32)
    wrapped = np.concatenate([second, second[:COORDINATES]])
    return scatter, np.lib.stride_tricks.sliding_window_view(wrapped, COORDINATES)[:SLOTS]


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct digests of the ``words``-word shingles of a text whose A-Z are lower-cased; fewer words make one shingle."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    tokens = word_tokens(found)
    rolled = Rolling(tokens)
    return np.unique(rolled.windows(words) if len(found) >= words else rolled.slices(np.array([0]), np.array([len(found)])))


def signature(shingles: np.ndarray) -> np.ndarray:
    scatter, shifted = permutations()
    slots = np.unique(scatter[(mix(shingles) >> np.uint64(46)).astype(np.int64)])
    least = shifted[slots[:512]].min(axis=0)
    for at in range(512, len(slots), 512):
        np.minimum(least, shifted[slots[at : at + 512]].min(axis=0), out=least)
    return least


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        with np.errstate(over="ignore"):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key


def vertex(shingles: np.ndarray) -> tuple[int, int]:
    """Two 64-bit digests of a whole set."""
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
            out.append(int(signed(mix(np.array([mix(shingles ^ np.uint64(salt)).sum() + np.uint64(len(shingles))], np.uint64)))[0]))
    return out[0], out[1]


def link_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, id_column: str = "doc_id", text: str = "text", text_hash: str | None = None) -> DataFrame:
    """One row for each document: id, n_shingles, component_id (least id reachable over links), kept (id = component_id).

    Linked are documents whose intersection holds at least ``similarity`` of the union of their shingle sets.  Documents without
    words are linked with nothing.  Rows with the same id count as documents of their own; rows with a null id take part, and have a
    null component_id only where no member has an id.  A column ``text_hash`` (xxhash64 of the text), if named, tells rows of one id apart.
    """
    spark = docs.sparkSession
    small_batches(spark)
    hundredths = round(similarity * 100)
    given = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    hashed = given.withColumn("hash", F.xxhash64("text"))

    def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingle_set(t, words) for t in b["text"]]
            marks = [vertex(s) if len(s) else (None, None) for s in sets]
            v, w = (pd.array([m[i] for m in marks], dtype="Int64") for i in (0, 1))
            bands = [signed(band_keys(signature(s))) if len(s) else None for s in sets]
            yield pd.DataFrame({"id": b["id"].astype("Int64"), "hash": b["hash"], "n_shingles": [len(s) for s in sets], "v": v, "w": w, "bands": bands})

    made = checkpoint(hashed.mapInPandas(signatures, "id long, hash long, n_shingles long, v long, w long, bands array<long>"))
    made, clashes = _told_apart(made)
    found = made.where("v is not null")
    least = found.groupBy("v").agg(F.min("id").alias("least"))
    # The joins' keys are structs, not the aggregates' columns: both sides are shuffled for them, so Spark can split a hot key.
    keyed = found.select("v", "bands").dropDuplicates(["v"]).select("v", F.explode("bands").alias("bucket"))
    shared = keyed.groupBy("bucket").count().where("count > 1").select(F.struct("bucket").alias("key"))
    members = checkpoint(keyed.withColumn("key", F.struct("bucket")).join(shared, "key").drop("key"))
    labels = None
    if has_rows(members):
        hubs = members.groupBy("bucket").agg(F.min("v").alias("hub")).select(F.struct("bucket").alias("key"), "hub")
        groups = checkpoint(members.withColumn("key", F.struct("bucket")).join(hubs, "key").select("hub", "v").distinct())
        needed = checkpoint(_with_sets(given, found, groups, words, clashes))
        labels = _labels(groups, needed, hundredths)
    if labels is None:
        known = least.select(F.struct("v").alias("key"), F.col("least").alias("component_id"))
    else:
        joined = labels.join(least, "v")
        first = joined.groupBy("label").agg(F.min("least").alias("component_id")).select(F.struct("label").alias("key"), "component_id")
        linked = joined.select("v", F.struct("label").alias("key")).join(first, "key").select("v", "component_id", F.lit(True).alias("linked"))
        known = least.join(linked, "v", "left").select(F.struct("v").alias("key"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    full = found.select("id", "hash", "n_shingles", F.struct("v").alias("key")).join(known, "key").select("id", "hash", "n_shingles", "component_id")
    out = full.unionAll(made.where("v is null").select("id", "hash", "n_shingles", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_column), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"), *([F.col("hash").alias(text_hash)] if text_hash else []))


def _told_apart(made: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose different sets share the first digest get both digests as their vertex; and those first digests, if any."""
    clashes = made.where("v is not null").groupBy("v").agg(F.min("w").alias("low"), F.max("w").alias("high")).where("low <> high").select("v")
    if not has_rows(clashes):
        return made, None
    clashes = checkpoint(clashes)
    return checkpoint(_renamed(made, clashes)), clashes


def _renamed(rows: DataFrame, clashes: DataFrame) -> DataFrame:
    columns = [F.when(F.col("clash"), F.xxhash64("v", "w")).otherwise(F.col("v")).alias("v") if c == "v" else F.col(c) for c in rows.columns]
    return rows.join(clashes.withColumn("clash", F.lit(True)), "v", "left").select(*columns)


def _with_sets(given: DataFrame, found: DataFrame, groups: DataFrame, words: int, clashes: DataFrame | None) -> DataFrame:
    """(v, n, shingles) of the vertices that met another one; only their texts go through Python."""
    wanted = found.join(groups.select("v").distinct(), "v", "left_semi").groupBy("v").agg(F.min("id").alias("id"), F.count("id").alias("n"))
    texts = given.join(wanted.where("n > 0").select("id").distinct(), "id", "left_semi").select("text")
    if has_rows(given.where("id is null")):  # their sets may be no other row's
        texts = texts.unionAll(given.where("id is null").select("text"))

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [s for s in (shingle_set(t, words) for t in b["text"]) if len(s)]
            yield pd.DataFrame([(*vertex(s), len(s), signed(s)) for s in found], columns=["v", "w", "n", "shingles"])

    sets = texts.mapInPandas(shingles, "v long, w long, n long, shingles array<long>")
    return (sets if clashes is None else _renamed(sets, clashes)).drop("w").dropDuplicates(["v"])


def _labels(groups: DataFrame, needed: DataFrame, hundredths: int) -> DataFrame:
    """(v, label) of the vertices that are linked with any other; vertices of one component share a label."""
    a = groups.where("v <> hub").join(needed, "v").select("v", F.struct("hub").alias("key"), "n", "shingles")
    b = needed.select(F.struct(F.col("v").alias("hub")).alias("key"), F.col("n").alias("hub_n"), F.col("shingles").alias("hub_shingles"))
    common = F.when(F.lit(100) * F.least("n", "hub_n") >= F.lit(hundredths) * F.greatest("n", "hub_n"), F.size(F.array_intersect("shingles", "hub_shingles"))).otherwise(0)
    pairs = a.join(b, "key").select("v", "key.hub", "n", "hub_n", common.alias("common"))
    links = checkpoint(pairs.where(F.lit(100) * F.col("common") >= F.lit(hundredths) * (F.col("n") + F.col("hub_n") - F.col("common"))).select("v", "hub"))
    labels = checkpoint(connected_components(links.select(F.col("v").alias("a"), F.col("hub").alias("b"))).select(F.col("node").alias("v"), "label"))
    more = checkpoint(_links_across(groups, needed, labels, hundredths))
    if not has_rows(more):
        return labels
    joined = connected_components(more).select(F.col("node").alias("label"), F.col("label").alias("to"))
    labels = labels.unionAll(more.select(F.explode(F.array("a", "b")).alias("v")).distinct().select("v", F.col("v").alias("label"))).distinct()
    labels = labels.join(joined.select(F.struct("label").alias("key"), "to"), labels.label == F.col("key.label"), "left")
    return checkpoint(labels.select("v", F.coalesce("to", "label").alias("label")).distinct())


def _links_across(groups: DataFrame, needed: DataFrame, labels: DataFrame, hundredths: int) -> DataFrame:
    """Links (a, b) between labels of one group: the members outside its largest component against all its members.

    A group is cut into blocks of queries and of members by the sizes of their sets; each block counts shared shingles in one pass
    and returns at most one link from a query to each component.
    """
    held = groups.join(needed.select("v", "n").join(labels, "v", "left"), "v").select("hub", "v", "n", F.coalesce("label", "v").alias("label"))
    held = checkpoint(held)
    counted = held.groupBy("hub", "label").agg(F.count("*").alias("k"), F.sum("n").alias("size"))
    mixed = counted.groupBy("hub").agg(F.sum("k").alias("k"), F.sum("size").alias("size"), F.max(F.struct("k", "label", "size")).alias("main")).where("main.k < k and k > 2")
    parts = lambda size, most: F.greatest(F.ceil(size / most), F.lit(1)).cast("int")
    mixed = mixed.select(F.struct("hub").alias("key"), F.col("main.label").alias("main"), parts(F.col("size") - F.col("main.size"), QUERY_SHINGLES).alias("q"), parts(F.col("size"), GROUP_SHINGLES).alias("g"))
    rows = checkpoint(held.withColumn("key", F.struct("hub")).join(mixed, "key").select("hub", "v", "label", "main", "q", "g"))
    both = rows.join(needed.select("v", "shingles"), "v")
    spread = lambda n: F.pmod(F.xxhash64("v"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # The hub has met all of its group.
    asks = both.where("label <> main and v <> hub").select("hub", spread("q").alias("i"), each("g").alias("j"), "v", "label", "shingles", F.lit(True).alias("asks"))
    all_of = both.where("v <> hub").select("hub", each("q").alias("i"), spread("g").alias("j"), "v", "label", "shingles", F.lit(False).alias("asks"))

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        queries, group = block[block["asks"]], block[~block["asks"]]
        out: list[tuple[int, int]] = []
        if len(queries) and len(group):
            sets = [np.asarray(x) for x in queries["shingles"]]
            sizes, own = np.array([len(x) for x in sets]), queries["label"].to_numpy()
            flat, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(flat, kind="stable")
            universe, first, times = np.unique(flat[order], return_index=True, return_counts=True)
            of = of[order]
            linked: set[tuple[int, int]] = set()
            for label, s in zip(group["label"], group["shingles"], strict=True):
                s = np.asarray(s)
                at = np.minimum(np.searchsorted(universe, s), len(universe) - 1)
                at = at[universe[at] == s]
                if not len(at):
                    continue
                n = times[at]
                places = np.repeat(first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                common = np.bincount(of[places], minlength=len(sets))
                for q in np.flatnonzero((100 * common >= hundredths * (sizes + len(s) - common)) & (own != label)):
                    if (q, label) not in linked:
                        linked.add((q, label))
                        out.append((min(label, own[q]), max(label, own[q])))
        return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype="int64")

    return asks.unionAll(all_of).groupBy("hub", "i", "j").applyInPandas(compare, "a long, b long").distinct()
