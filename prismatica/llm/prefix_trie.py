"""The trie of conversations' shared first turns, from sorted conversations, their common prefixes, and sparse tables of minima.

Conversations are sorted by the digests of their turns, so those that share their first d turns stand together.  With l(t), the number of
turns that conversation t shares with the one before, a prefix of depth d at t covers all neighbours up to the first l below d on each
side.  Each candidate prefix finds both ends by itself, by binary search in a sparse table of range minima; there is no stack and no
order among candidates.  Smallest members are range minima too; everything else about a node is a difference of prefix sums.

The sorted conversations lie in blocks, one for each range partition.  A block's least l and the l at its border are all that other
blocks need: a sparse table over blocks (at most ``MAX_BLOCKS``) finds where a prefix that enters a block began.  Nodes inside a block
are finished there.  Nodes that cross a border are few, at most one for each depth shared across it; each block they touch gives one
partial row, and those are summed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prismatica.llm.common import checkpoint, small_batches

#: Turns of a block on average, and the most blocks there are; beyond both, blocks grow.
BLOCK_TURNS, MAX_BLOCKS = 200_000, 16_384
#: Bytes of a turn's digest.
KEY = 16
NOTHING = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
INSIDE, ACROSS, ENDS = 0, 1, 2
SCHEMA = "kind int, block long, depth long, part long, conv_id long, parent_block long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, ids string"


# ---------------------------------------------------------------------------------------------- sequences of turns


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (array of key, words): one row for each conv_id that isn't null, its rows by turn, null first, then role, then text.

    Null role and text are empty; repeated rows stay.  A turn's key is a 128-bit digest (of SHA-256) of its role and text, so texts move
    once, to be sorted, and only keys and numbers of words from then on.  One conversation is one row, of about 40 bytes a turn, so it
    may have tens of millions of turns at most.
    """
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    key = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, 2 * KEY)
    turns = rows.select("conv_id", F.row_number().over(order).alias("at"), key.alias("key"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))
    found = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "key", "words"))).alias("turns"))
    return found.select("conv_id", F.expr("transform(turns, t -> struct(t.key as key, t.words as words))").alias("turns"))


def with_openings(found: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """Every conversation c begins with the first h turns of conversation c - c mod ``every``, then its own after its first h.

    h is the checksum of c's decimal digits modulo ``most``.  Missing turns are left out, so a conversation may end up without any.  For
    negative ids the multiple of ``every`` is the one below.
    """
    base = F.expr(f"conv_id - pmod(conv_id, {every})")
    heads = found.where(f"pmod(conv_id, {every}) = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    own = found.withColumn("base", base).withColumn("h", F.expr(f"int(crc32(cast(string(conv_id) as binary)) % {most})"))
    made = own.join(heads, "base", "left")
    taken = F.expr("concat(slice(coalesce(head, slice(turns, 1, 0)), 1, h), slice(turns, h + 1, greatest(size(turns), 1)))")
    return made.select("conv_id", taken.alias("turns"))


# ---------------------------------------------------------------------------------------------- range minima


class SparseTable:
    """Minima of all stretches whose lengths are powers of two; a stretch of any length is two of them that overlap."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while len(self.levels[-1]) > 1 << (len(self.levels) - 1):
            step = 1 << (len(self.levels) - 1)
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-step], last[step:]))

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Minima of values[first..last], which are never empty."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), self.levels[0].dtype)
        for k in np.unique(level).tolist():
            of = level == k
            out[of] = np.minimum(self.levels[k][first[of]], self.levels[k][last[of] - (1 << k) + 1])
        return out

    def rightwards(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Largest r with values[start + 1..r] all at least ``depth``."""
        at, n = start.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at + (1 << k) < n
            fits[fits] = self.levels[k][at[fits] + 1] >= depth[fits]
            at[fits] += 1 << k
        return at

    def leftwards(self, start: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Smallest l with values[l + 1..start] all at least ``depth``."""
        at = start.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            fits = at - (1 << k) >= 0
            fits[fits] = self.levels[k][at[fits] - (1 << k) + 1] >= depth[fits]
            at[fits] -= 1 << k
        return at


def shared(keys: list[bytes]) -> np.ndarray:
    """Number of turns that each sequence shares with the one before; 0 for the first."""
    sizes = np.array([len(k) // KEY for k in keys], np.int64)
    flat = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, KEY // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    out = np.zeros(len(keys), np.int64)
    both = np.minimum(sizes[1:], sizes[:-1])
    pair = np.flatnonzero(both)
    if len(pair):
        n = both[pair]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        differ = (flat[np.repeat(starts[pair], n) + within] != flat[np.repeat(starts[pair + 1], n) + within]).any(axis=1)
        out[pair + 1] = np.minimum.reduceat(np.where(differ, within, np.repeat(n, n)), np.cumsum(n) - n)
    return out


# ---------------------------------------------------------------------------------------------- blocks


@dataclass
class Blocks:
    """What all blocks know of each other: numbers of those with rows, turns shared at each one's border with the one before (-1: first),
    whether its first sequence is that one's last, and the least that neighbours share within a block and at its border."""

    number: np.ndarray
    border: np.ndarray
    copy: np.ndarray
    least: np.ndarray

    def began(self, block: int, depth: np.ndarray) -> np.ndarray:
        """Numbers of the blocks where prefixes began that enter ``block`` (its place) from the left."""
        table = SparseTable(self.least)
        return self.number[table.leftwards(np.full(len(depth), block - 1), depth)] if block else np.empty(0, np.int64)


def _blocks(ordered: DataFrame) -> Blocks:
    """One row for each block goes to the driver: at most ``MAX_BLOCKS``."""

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = number = None
        least = np.iinfo(np.int64).max
        for b in batches:
            keys = b["key"].tolist()
            if not keys:
                continue
            if first is None:
                first, number = keys[0], int(b["block"].iloc[0])
            else:
                keys.insert(0, last)
            least, last = min(least, *shared(keys)[1:].tolist()) if len(keys) > 1 else least, keys[-1]
        if first is not None:
            yield pd.DataFrame({"block": [number], "first": [first], "last": [last], "least": [least]})

    found = ordered.select("block", "key").mapInPandas(edges, "block long, first binary, last binary, least long")

    @F.pandas_udf("long")
    def common(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([-1 if x is None else int(shared([x, y])[1]) for x, y in zip(a, b, strict=True)], dtype="int64")

    near = found.withColumn("before", F.lag("last").over(Window.orderBy("block")))
    rows = near.select("block", common("before", "first").alias("border"), (F.length("first") / KEY).cast("long").alias("size"), "least").orderBy("block").toPandas()
    border = rows["border"].to_numpy(np.int64)
    return Blocks(rows["block"].to_numpy(np.int64), border, border == rows["size"].to_numpy(np.int64), np.minimum(rows["least"].to_numpy(np.int64), border))


def block_nodes(blocks: Blocks, number: int, ids: np.ndarray, keys: list[bytes], words: list[np.ndarray]) -> tuple[pd.DataFrame, pd.DataFrame]:
    """All rows of one block: finished nodes and parts of nodes that cross its borders; and ids of equal sequences that do."""
    n, place = len(keys), int(np.searchsorted(blocks.number, number))
    sizes = np.array([len(k) // KEY for k in keys], np.int64)
    common = shared(keys)
    common[0] = blocks.border[place]
    more = place + 1 < len(blocks.number)
    after = int(blocks.border[place + 1]) if more else -1
    following = np.append(common[1:], after)

    table, smallest = SparseTable(common), SparseTable(ids)
    # Candidates: prefixes that begin at a conversation; at the block's first one, also those that enter from the left.
    lowest = common + 1
    lowest[0] = 0
    counts = sizes - lowest + 1
    at = np.repeat(np.arange(n), counts)
    depth = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts) + lowest[at]
    enters = (at == 0) & (depth <= common[0])
    last = table.rightwards(at, depth)
    leaves_block = (last == n - 1) & (after >= depth)

    sums = lambda values: np.concatenate([[0], np.cumsum(values)])
    spoken = sums(np.concatenate([*words, np.empty(0, np.int64)]))
    start = np.cumsum(sizes) - sizes
    upto = lambda t, d: spoken[start[t] + np.maximum(d, 0)] - spoken[start[t]]  # noqa: E731  words of the first d turns
    total = upto(np.arange(n), sizes)
    fresh = sums(total - upto(np.arange(n), common))  # words of the nodes that begin at each conversation
    totals, childless = sums(total), sums(following < sizes)

    members = last - at + 1
    above = upto(at, depth - 1)
    inside = np.where(enters, fresh[last + 1] - fresh[at], fresh[last + 1] - fresh[at + 1] + total[at] - above)
    saved = totals[last + 1] - totals[at] - members * above - inside
    born = np.sort((common * n + np.arange(n))[(sizes > common) & (common >= 0)])
    within = lambda d, a, z: np.searchsorted(born, d * n + z, "right") - np.searchsorted(born, d * n + a, "left")
    children = np.where(enters, within(depth, at, last), within(depth, at + 1, last) + (sizes[at] > depth))

    # The parent is one turn shorter: its own ends are searched for in the same way.
    parent = np.maximum(depth - 1, 0)
    parent_first, parent_last = table.leftwards(at, parent), table.rightwards(at, parent)
    parent_enters = (parent_first == 0) & (common[0] >= parent)
    parent_open = (parent_enters | ((parent_last == n - 1) & (after >= parent))) & (depth > 0)
    known = (depth > 0) & ~parent_open
    parent_conv, parent_block = np.full(len(at), -1), np.full(len(at), number)
    parent_conv[known] = smallest.least(parent_first[known], parent_last[known])
    entering = parent_open & parent_enters
    parent_block[entering] = blocks.began(place, parent[entering]) if place else number
    block = np.full(len(at), number)
    block[enters] = blocks.began(place, depth[enters]) if place else number

    # Equal sequences stand together, their ids ascending.
    copy = common == sizes
    firsts = np.flatnonzero(~copy | (np.arange(n) == 0))
    digests, parts = np.full(n, None, object), []
    for a, z in zip(firsts.tolist(), [*firsts[1:].tolist(), n], strict=True):
        text = ",".join(map(str, ids[a:z].tolist()))
        if copy[a] or (z == n and more and blocks.copy[place + 1]):
            began = int(blocks.began(place, sizes[:1])[0]) if copy[a] else number
            parts.append((ENDS, began, int(sizes[a]), number, text))
        else:
            digests[a] = hashlib.sha256(text.encode()).hexdigest()
    ends = np.full(len(at), NOTHING, object)
    ends[depth == sizes[at]] = digests[at[depth == sizes[at]]]
    ends[enters] = None
    across = enters | leaves_block

    nullable = lambda values, where: pd.Series(values, dtype="Int64").where(where)
    nodes = pd.DataFrame(
        {
            "kind": np.where(across, ACROSS, INSIDE).astype(np.int32),
            "block": nullable(block, across),
            "depth": depth,
            "part": number,
            "conv_id": smallest.least(at, last),
            "parent_block": nullable(parent_block, parent_open & ~enters),
            "parent_conv_id": nullable(parent_conv, known),
            "n_convs": members,
            "n_children": children,
            "n_leaves": childless[last + 1] - childless[at],
            "saved_tokens": saved,
            "ends_sha256": ends,
            "ids": None,
        }
    )
    tail = pd.DataFrame(parts, columns=["kind", "block", "depth", "part", "ids"], dtype=object)
    return nodes, tail.assign(**dict.fromkeys(set(nodes.columns) - set(tail.columns)))[nodes.columns]


def trie(found: DataFrame) -> DataFrame:
    """All nodes of ``found(conv_id, turns)``, whose ids are distinct: a conversation prefix each, from the root of depth 0.

    conv_id (smallest member), depth, parent_conv_id (the parent's smallest member), n_convs, n_children, n_leaves (childless nodes of its
    subtree), saved_tokens (words that members after the first of each node of its subtree repeat in its last turn), ends_sha256 (digest
    of the ids of conversations that end here).  No conversations: no nodes, not even a root.
    """
    spark = found.sparkSession
    small_batches(spark, 4096)
    found = checkpoint(found.select("conv_id", F.expr("unhex(array_join(transform(turns, t -> t.key), ''))").alias("key"), F.expr("transform(turns, t -> t.words)").alias("words")))
    turns = found.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    count = max(1, min(MAX_BLOCKS, -(-turns // BLOCK_TURNS)))
    ordered = checkpoint(found.repartitionByRange(count, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("block", F.spark_partition_id().cast("long")))
    blocks = _blocks(ordered)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        ids = np.concatenate([b["conv_id"].to_numpy(np.int64) for b in parts])
        keys = [k for b in parts for k in b["key"]]
        words = [np.asarray(w, np.int64) for b in parts for w in b["words"]]
        number = int(parts[0]["block"].iloc[0])
        parts.clear()
        for made in block_nodes(blocks, number, ids, keys, words):
            for a in range(0, len(made), 50_000):
                yield made.iloc[a : a + 50_000]

    made = checkpoint(ordered.mapInPandas(run, SCHEMA))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    parts = made.where(F.col("kind") == ACROSS).groupBy("block", "depth")
    crossing = parts.agg(F.min("conv_id").alias("conv_id"), F.max("parent_block").alias("parent_block"), F.max("ends_sha256").alias("ends_sha256"), *sums)
    crossing = crossing.join(_ends(made).withColumnRenamed("ends_sha256", "late"), ["block", "depth"], "left").withColumn("ends_sha256", F.coalesce("late", "ends_sha256"))
    crossing = checkpoint(crossing.withColumn("parent_conv_id", F.lit(None).cast("long")))
    names = ["conv_id", "depth", "parent_block", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = made.where(F.col("kind") == INSIDE).select(names).unionAll(crossing.select(names))
    result = [c for c in names if c != "parent_block"]
    # The root may be the parent of most nodes: the key is a struct that only this join uses, so that Spark can split it.
    pair = lambda block, depth: F.struct(F.col(block).alias("block"), depth.alias("depth"))
    parents = crossing.select(pair("block", F.col("depth")).alias("key"), F.col("conv_id").alias("above"))
    late = nodes.where("parent_block is not null").withColumn("key", pair("parent_block", F.col("depth") - 1)).join(parents, "key", "left")
    return nodes.where("parent_block is null").select(result).unionAll(late.withColumn("parent_conv_id", F.col("above")).select(result))


def _ends(made: DataFrame) -> DataFrame:
    """block, depth, ends_sha256 of the nodes whose equal sequences lie in several blocks: their ids stream by in order."""
    rows = made.where(F.col("kind") == ENDS).select("block", "depth", "part", "ids")
    rows = rows.repartition("block", "depth").sortWithinPartitions("block", "depth", "part")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, digest = None, None
        for b in batches:
            done = []
            for block, depth, ids in zip(b["block"], b["depth"], b["ids"], strict=True):
                if (block, depth) != current:
                    if current is not None:
                        done.append((*current, digest.hexdigest()))
                    current, digest = (block, depth), hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["block", "depth", "ends_sha256"], dtype=object)
        if current is not None:
            yield pd.DataFrame([(*current, digest.hexdigest())], columns=["block", "depth", "ends_sha256"], dtype=object)

    return rows.mapInPandas(run, "block long, depth long, ends_sha256 string")


def prefix_nodes(conversations: DataFrame) -> DataFrame:
    """The contract's nodes: of all conversations, with the openings that ``with_openings`` gives them.

    Rows with a null conv_id belong to no conversation and are left out; other columns are not read.
    """
    return trie(with_openings(checkpoint(sequences(conversations))))


def brute_force(rows: list[tuple[int, list[tuple[str, str]]]]) -> set[tuple]:
    """All nodes of (conv_id, turns) by a dictionary of prefixes; for tests."""
    members: dict[tuple, list[int]] = {}
    for c, turns in rows:
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    ends = {tuple(t): sorted(c for c, u in rows if u == list(t)) for t in {tuple(t) for _, t in rows}}
    out = set()
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        children = sum(len(q) == len(p) + 1 for q in below)
        leaves = sum(q not in {r[:-1] for r in members if r} for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode().split()) for q in below if q)
        digest = hashlib.sha256(",".join(map(str, ends.get(p, []))).encode()).hexdigest()
        out.add((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children, leaves, saved, digest))
    return out
