"""Removal of long repeated byte strings by a distributed merge sort of sampled suffixes.

Every window of ``window`` bytes is attached to the suffix that starts at its least k-mer, so equal windows hang on suffixes that share
a k-mer, at the same offset.  Suffixes whose k-mer occurs once drop out.  The others are sorted in runs where their texts lie, front
coded (the length shared with the string before, and the rest), exchanged by k-mer, and merged by a loser tree that carries known
common prefixes and never compares them again.  The merge yields the common prefix of neighbours.  Within a k-mer, suffixes are
split by their left context byte by byte only where it differs; a window is repeated if, among suffixes with its left part, a
neighbour shares its right part.

Texts are told apart, and copies known, by 128-bit digests.  Windows that repeat within one text are settled there, and only their
first occurrence goes on.  A k-mer with more than ``HOT`` suffixes isn't gathered: its windows are counted by 128-bit digests.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatica.llm.common import checkpoint, has_rows, names_apart, small_batches
from prismatica.llm.rolling import BASES, Rolling, covered, mix, runs, signed, sliding_least

K = 32
#: Suffixes of one k-mer that one task may gather.
HOT = 50_000
#: Suffixes for each merging task, and bytes of a sorted run before it is sent.
SUFFIXES_A_TASK, RUN_BYTES = 25_000, 24_000_000
#: Where a suffix stands: id and 128-bit digest of its text, position, least and most left length.
PLACE = "<q16siII"
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def attached_nodes(data: bytes, window: int):
    """Nodes of a text of at least ``window`` bytes: k-mer digest, position, least and most left length of the attached windows; and
    the window starts that repeat within the text."""
    rolled = Rolling(BYTES[np.frombuffer(data, np.uint8)])
    kmers = rolled.windows(K)
    node = sliding_least(kmers, window - K + 1)
    starts = np.arange(len(node))
    local = np.empty(0, np.int64)
    first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    heads = kmers[node[first]]
    if len(np.unique(heads)) < len(heads):  # else no window can repeat within the text
        digests = rolled.windows(window)
        _, back, copies = np.unique(digests, return_inverse=True, return_counts=True)
        again = copies[back] > 1
        if again.any():
            local = starts[again]
            _, fresh = np.unique(digests, return_index=True)
            starts = np.sort(fresh)
            node = node[starts]
            first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
    last = np.append(first[1:], len(node)) - 1
    at = node[first]
    return kmers[at], at, at - starts[last], at - starts[first], local


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which ``known`` bytes are known and not compared."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return known + len(x) - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def front_coded(entries: list[tuple[bytes, bytes]]) -> bytes:
    """Sorted (suffix, payload) pairs as bytes, each suffix less what it shares with the one before."""
    out, before = [], b""
    for suffix, payload in entries:
        common = shared(before, suffix)
        out.append(struct.pack("<III", common, len(suffix) - common, len(payload)))
        out.append(suffix[common:])
        out.append(payload)
        before = suffix
    return b"".join(out)


def decoded(run: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """(suffix, length shared with the one before, payload)."""
    at, before = 0, b""
    while at < len(run):
        common, rest, size = struct.unpack_from("<III", run, at)
        at += 12
        before = before[:common] + run[at : at + rest]
        at += rest
        yield before, common, run[at : at + size]
        at += size


def merged(sorted_runs: list[Iterator[tuple[bytes, int, bytes]]]) -> Iterator[tuple[bytes, int, bytes]]:
    """Loser tree over sorted runs: (suffix, length shared with the one before in the merged order, payload).

    Each run's head knows its common prefix with the last winner.  Of two heads the one that shares more is smaller; only where they
    share the same length are they compared, from there on.  The loser then knows its common prefix with the winner.
    """
    k = len(sorted_runs)
    heads: list[tuple[bytes, int, bytes] | None] = [next(r, None) for r in sorted_runs]
    known = [0] * k
    tree = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser of two runs."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        common = shared(x[0], y[0], known[a])
        if len(x[0]) == common or (len(y[0]) > common and x[0][common] < y[0][common]):
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    def build(at: int) -> int:
        if at >= k:
            return at - k
        winner, tree[at] = play(build(2 * at), build(2 * at + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        suffix, _, payload = heads[winner]
        yield suffix, known[winner], payload
        heads[winner] = head = next(sorted_runs[winner], None)
        known[winner] = head[1] if head is not None else 0
        at = (winner + k) // 2
        while at:
            winner, tree[at] = play(winner, tree[at])
            at //= 2


def repeated_lengths(members: list[tuple[bytes, int, int, int, int]], window: int) -> list[list[tuple[int, int]]]:
    """For suffixes of one k-mer in sorted order, given as (left context, least, most left length, common prefix with the one before,
    copies), the ranges of left lengths (inclusive) whose windows occur more than once."""
    found: list[list[tuple[int, int]]] = [[(low, high)] if copies > 1 else [] for _, low, high, _, copies in members]
    if len(members) < 2:
        return found
    backwards = [m[0][::-1] for m in members]
    prefix = [m[3] for m in members]
    work = [(list(range(len(members))), [0, *prefix[1:]], 0)]  # class in sorted order, common prefixes with the one before, left length
    while work:
        group, common, depth = work.pop()
        if max(common[1:]) + max(members[m][2] for m in group) < window:
            continue  # no two share a window's right part
        by_left = sorted(group, key=backwards.__getitem__)
        split = min(shared(backwards[a], backwards[b], depth) for a, b in zip(by_left, by_left[1:], strict=False))
        for i, member in enumerate(group):
            best = max(common[i] if i else 0, common[i + 1] if i + 1 < len(group) else 0)
            _, low, high, _, copies = members[member]
            a, b = max(window - best, depth, low), min(split, high)
            if a <= b and copies < 2:
                found[member].append((a, b))
        parts: dict[bytes, list[int]] = defaultdict(list)
        for i, member in enumerate(group):
            if len(backwards[member]) > split:
                parts[backwards[member][: split + 1]].append(i)
        for places in parts.values():
            if len(places) > 1:
                inner = [0]
                for x, y in zip(places, places[1:], strict=False):
                    inner.append(min(common[x + 1 : y + 1]))
                work.append(([group[i] for i in places], inner, split + 1))
    return found


def _pack(doc: int, th: bytes, at: int, low: int, high: int, left: bytes) -> bytes:
    return struct.pack(PLACE, doc, th, at, low, high) + left


@names_apart("doc_id", replaced=("data", "lo", "hi"))
def repeated_spans(docs: DataFrame, window: int = 400) -> DataFrame:
    """Every row with data (its UTF-8 bytes) and lo, hi: starts and ends of strings to remove, which may overlap.

    A string of ``window`` bytes is removed wherever it starts, if it starts at any other place, in the same text or another; texts
    are judged as given.  A null text has no bytes; shorter texts lose nothing; repeated rows are copies of each other, whatever
    their ids, null ones included.  Columns named as the results are replaced.
    """
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c not in ("text", "data", "lo", "hi")]
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("__doc"), F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("__th"), F.col("text").cast("string").cast("binary").alias("__data"), *[F.col(f"`{c}`") for c in keep])

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc, th, data in zip(b["__doc"], b["__th"], b["__data"], strict=True):
                head, at, low, high, local = attached_nodes(data, window)
                a, z = runs(covered(len(data), local, local + 1)) if len(local) else (local, local)
                rows.append((doc, th, signed(head), at, low, high, a, z))
            yield pd.DataFrame(rows, columns=["__doc", "__th", "head", "at", "low", "high", "local_from", "local_to"])

    ints = "array<int>"
    texts = checkpoint(base.select("__doc", "__th", "__data").where(F.octet_length("__data") >= window).mapInPandas(nodes, f"__doc long, __th binary, head array<long>, at {ints}, low {ints}, high {ints}, local_from {ints}, local_to {ints}"))
    # Copies: all their bytes go; the one with the least id stands for them.
    # The join's key is a struct, not the aggregate's column: both of its sides are shuffled for it, so Spark can split a hot group.
    alike = F.struct("__th").alias("alike")
    same = texts.groupBy("__th").agg(F.count("*").alias("copies"), F.min("__doc").alias("chosen")).select(alike, "copies", "chosen")
    marked = texts.select("*", alike).join(same, "alike").drop("alike")
    node = marked.where("__doc = chosen").select("__doc", "__th", F.explode(F.arrays_zip("head", "at", "low", "high")).alias("n")).select("__doc", "__th", "n.*")
    counted = node.groupBy("head").agg(F.count("*").alias("n")).where("n > 1")
    known = checkpoint(node.join(counted, "head"))
    warm = known.where(F.col("n") <= HOT).groupBy("__doc", "__th").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("k"))
    warm = warm.select("__doc", "__th", *[F.col(f"k.{c}").alias(c) for c in ("at", "low", "high")])
    tasks = max(1, -(-known.count() // SUFFIXES_A_TASK))

    dealt = base.repartition("__doc", "__th")  # the one shuffle of texts, shared by the passes below
    here = dealt.select("__doc", "__th", "__data").join(warm.hint("shuffle_hash"), ["__doc", "__th"])

    def sorted_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[bytes, bytes]]] = defaultdict(list)
        size = 0

        def flush() -> pd.DataFrame:
            out = [(task, front_coded(sorted(entries))) for task, entries in held.items()]
            held.clear()
            return pd.DataFrame(out, columns=["task", "run"])

        for b in batches:
            seen = set()
            for doc, th, data, ats, lows, highs in zip(b["__doc"], b["__th"], b["__data"], b["at"], b["low"], b["high"], strict=True):
                if (doc, th) in seen:
                    continue
                seen.add((doc, th))
                for at, low, high in zip(ats.tolist(), lows.tolist(), highs.tolist(), strict=True):
                    suffix = data[at : at + window - low]
                    held[_task(suffix, tasks)].append((suffix, _pack(doc, th, at, low, high, data[at - high : at])))
                    size += window + high - low
                if size >= RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = {c: [] for c in ("__doc", "__th", "lo", "hi")}
        members: list[tuple[bytes, int, int, int, int]] = []
        places: list[list[tuple[int, bytes, int]]] = []
        before = b""

        def settle() -> None:
            if len(members) > 1 or members and members[0][4] > 1:
                for spans, where in zip(repeated_lengths(members, window), places, strict=True):
                    for low, high in spans:
                        for doc, th, at in where:
                            out["__doc"].append(doc), out["__th"].append(th), out["lo"].append(at - high), out["hi"].append(at - low + window)
            members.clear(), places.clear()

        for suffix, common, payload in merged([decoded(r) for r in group["run"]]):
            doc, th, at, low, high = struct.unpack_from(PLACE, payload)
            left = payload[struct.calcsize(PLACE) :]
            if suffix[:K] != before[:K]:
                settle()
            if members and suffix == before and left == members[-1][0] and (low, high) == members[-1][1:3]:
                where = (doc, th, at)
                if where not in places[-1][-1:]:
                    places[-1].append(where)
                    members[-1] = (*members[-1][:4], len(places[-1]))
            else:
                members.append((left, low, high, common if members else 0, 1))
                places.append([(doc, th, at)])
            before = suffix
        settle()
        return pd.DataFrame(out)

    spans = here.mapInPandas(sorted_runs, "task int, run binary").groupBy("task").applyInPandas(merge, "__doc long, __th binary, lo int, hi int")
    hot = known.where(F.col("n") > HOT)
    if has_rows(hot):
        spans = spans.unionByName(_hot_spans(dealt, hot, window))
    lists = spans.groupBy("__doc", "__th").agg(F.collect_list("lo").alias("__lo"), F.collect_list("hi").alias("__hi"))
    whole = marked.select("__doc", "__th", F.col("copies").alias("__copies"), F.col("local_from").alias("__from"), F.col("local_to").alias("__to")).dropDuplicates(["__doc", "__th"])
    whole = dealt.join(whole.hint("shuffle_hash"), ["__doc", "__th"], "left").join(lists.hint("shuffle_hash"), ["__doc", "__th"], "left")
    n, none = F.octet_length("__data"), F.array().cast(ints)
    own = F.when(F.col("__copies") > 1, F.array(F.lit(0))), F.when(F.col("__copies") > 1, F.array(n))
    lo = F.concat(F.coalesce(own[0], none), F.coalesce("__from", none), F.coalesce("__lo", none))
    hi = F.concat(F.coalesce(own[1], none), F.coalesce(F.transform("__to", lambda x: x + (window - 1)), none), F.coalesce("__hi", none))
    return whole.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("__data", F.lit(b"")).alias("data"), lo.alias("lo"), hi.alias("hi"))


def _task(suffix: bytes, tasks: int) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(suffix[:K], 7) % tasks


def _hot_spans(dealt: DataFrame, hot: DataFrame, window: int) -> DataFrame:
    """Repeated windows of k-mers that too many suffixes share: counted by digests, partly where they are made."""
    lists = hot.groupBy("__doc", "__th").agg(F.sort_array(F.collect_list(F.struct("at", "low", "high"))).alias("k"))
    here = dealt.select("__doc", "__th", "__data").join(lists.hint("shuffle_hash"), ["__doc", "__th"]).select("__doc", "__th", "__data", *[F.col(f"k.{c}").alias(c) for c in ("at", "low", "high")])

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, th, data, at, low, high in zip(b["__doc"], b["__th"], b["__data"], b["at"], b["low"], b["high"], strict=True):
                tokens = BYTES[np.frombuffer(data, np.uint8)]
                s = np.unique(np.concatenate([np.arange(a - h, a - w + 1) for a, w, h in zip(at, low, high, strict=True)]))
                yield pd.DataFrame({"__doc": doc, "__th": th, "lo": s, "w1": signed(Rolling(tokens).slices(s, s + window)), "w2": signed(Rolling(tokens, BASES[1]).slices(s, s + window))})

    made = here.mapInPandas(digests, "__doc long, __th binary, lo int, w1 long, w2 long")
    often = made.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return made.join(often, ["w1", "w2"]).select("__doc", "__th", "lo", (F.col("lo") + window).alias("hi"))


@names_apart("doc_id", replaced=("data", "lo", "hi", "kept", "n_bytes", "n_removed", "n_spans"))
def remove_repeats(docs: DataFrame, window: int = 400) -> DataFrame:
    """Every row of ``repeated_spans`` with kept (remaining bytes), n_bytes, n_removed and n_spans (maximal removed runs)."""
    spans = repeated_spans(docs, window)
    keep = [c for c in spans.columns if c not in ("data", "lo", "hi", "kept", "n_bytes", "n_removed", "n_spans")]
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for data, lo, hi in zip(b["data"], b["lo"], b["hi"], strict=True):
                if not len(lo):
                    rows.append((data, len(data), 0, 0))
                    continue
                gone = covered(len(data), np.asarray(lo), np.asarray(hi))
                rows.append((np.frombuffer(data, np.uint8)[~gone].tobytes(), len(data), int(gone.sum()), len(runs(gone)[0])))
            yield pd.concat([b[keep].reset_index(drop=True), pd.DataFrame(rows, columns=["kept", "n_bytes", "n_removed", "n_spans"])], axis=1)

    return spans.select(*[F.col(f"`{c}`") for c in keep], "data", "lo", "hi").mapInPandas(cut, f"{types}, kept binary, n_bytes long, n_removed long, n_spans long")


def digest(docs: DataFrame, window: int = 400) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"), window)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]], window: int = 400) -> list[tuple[int, int, int, int, str]]:
    """The same result for a small table, window by window."""
    texts = [(d, (t or "").encode()) for d, t in rows]
    seen: dict[bytes, int] = defaultdict(int)
    for _, t in texts:
        for i in range(len(t) - window + 1):
            seen[t[i : i + window]] += 1
    out = []
    for d, t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                gone[i : i + window] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        out.append((d, len(t), int(gone.sum()), len(runs(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out
