"""Removal of long repeated word passages over a compacted De Bruijn graph.

Token k-mers at content-defined positions are the graph's nodes, and the words from one node to the end of the next are its edges, so
a passage is a path.  Nodes are joined on their k-mer; an edge of a document whose smallest source has the same edge is verified, and
verified edges that follow each other at the same source offset (a path that doesn't branch on the way) compact into one span of
source coordinates.  Windows of a repeated node outside such spans, near the ends of passages and at branches, are compared one by
one by digests of 96 bits.

Why this is exact: the smallest document with a window never has it in a verified span, since a span's text also lies in a smaller
document.  So that document always gives the window's digest, and every other document either has it verified or gives it too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatica.llm.common import checkpoint, names_apart, small_batches
from prismatica.llm.rolling import BASES, Rolling, covered, runs, signed, sliding_least

K = 16
#: Columns of what is known about a text's nodes.
FIELDS = ("__at", "__end", "__source", "__source_text", "__source_at", "__same")


def words_of(text: str) -> list[bytes]:
    """Maximal runs of characters other than ASCII white space, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").split()


def word_tokens(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def attached(rolled: Rolling, window: int) -> np.ndarray:
    """For each window, the position of its node: the leftmost least k-mer inside."""
    return sliding_least(rolled.windows(K), window - K + 1)


def graph_nodes(tokens: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes of one document: k-mer digest, edge digest, start, end of the edge.  A first node stands for the document's beginning."""
    n, rolled = len(tokens), Rolling(tokens)
    at = np.unique(attached(rolled, window))
    heads = rolled.slices(at, at + K)
    ends = np.append(at[1:] + K, n)
    edges = rolled.slices(at, ends)
    if at[0] > 0:
        first = rolled.slices(np.array([0]), np.array([at[0] + K]))
        return np.append(~first, heads), np.append(first, edges), np.append(0, at), np.append(at[0] + K, ends)
    return heads, edges, at, ends


def verified_spans(own, at, end, source, source_text, source_at, same) -> tuple[np.ndarray, np.ndarray]:
    """Spans of compacted paths: edges that a smaller document has too, joined while they go on at the same source offset."""
    good = same & (source < own)
    at, end, source, source_text, shift = at[good], end[good], source[good], source_text[good], (source_at - at)[good]
    if not len(at):
        return at, end
    new = np.ones(len(at), bool)
    new[1:] = (source[1:] != source[:-1]) | (source_text[1:] != source_text[:-1]) | (shift[1:] != shift[:-1]) | (at[1:] > end[:-1])
    first = np.flatnonzero(new)
    return at[first], np.maximum.reduceat(end, first)


def _known(row) -> tuple[np.ndarray, ...]:
    at, end, source, source_text, source_at, same = (np.asarray(row[c]) for c in FIELDS)
    _, keep = np.unique(at, return_index=True)
    return at[keep], end[keep], source[keep], source_text[keep], source_at[keep], same[keep].astype(bool)


def _records(batch: pd.DataFrame) -> Iterator[dict]:
    names = list(batch.columns)
    for values in zip(*[batch[c] for c in names], strict=True):
        yield dict(zip(names, values, strict=True))


@names_apart("doc_id", replaced=("kept", "n_words", "n_removed", "spans"))
def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """Every row with kept (its kept words joined by one space), n_words, n_removed and spans (removed word ranges, end exclusive).

    A word is removed if a window of ``window`` consecutive words over it, as given, also starts in a document with a smaller doc_id.
    A null text has no words; texts shorter than a window stay whole; rows with a null doc_id neither lose words nor serve as a
    source; rows with the same doc_id don't serve as each other's source.  Columns named as the results are replaced.
    """
    small_batches(docs.sparkSession)
    results = ("kept", "n_words", "n_removed", "spans")
    # A row's key is its doc_id with 32 bits that tell rows of the same id apart.
    keep = [c for c in docs.columns if c not in (*results, "text", "doc_id")]
    base = docs.select(F.col("doc_id").cast("long").alias("__doc"), F.hash("text").alias("__th"), F.col("text").cast("string").alias("__text"), *[F.col(f"`{c}`") for c in ("doc_id", *keep)])
    given = base.select("__doc", "__th", "__text").where("__doc is not null and length(__text) > 0")

    def nodes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for doc, th, text in zip(b["__doc"], b["__th"], b["__text"], strict=True):
                words = words_of(text)
                if len(words) >= window:
                    head, edge, at, end = graph_nodes(word_tokens(words), window)
                    parts.append((np.full(len(at), doc), np.full(len(at), th), signed(head), signed(edge), at, end))
            if parts:
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pd.DataFrame(dict(zip(("__doc", "__th", "head", "edge", "at", "end"), cols, strict=True)))

    made = given.mapInPandas(nodes, "__doc long, __th int, head long, edge long, at int, end int")
    # The joins' keys are structs, not the aggregates' columns: both sides are shuffled for them, so Spark can split a hot node or window.
    least = (
        made.groupBy("head")
        .agg(F.min(F.struct("__doc", "__th", "at", "edge")).alias("src"), F.max("__doc").alias("last"))
        .where("src.__doc < last")
        .select(F.struct("head").alias("node"), F.col("src.__doc").alias("source"), F.col("src.__th").alias("source_text"), F.col("src.at").alias("source_at"), F.col("src.edge").alias("source_edge"))
    )
    # At most a node for each word of a text in one list.
    joined = made.select("*", F.struct("head").alias("node")).join(least, "node").withColumn("same", F.col("edge") == F.col("source_edge"))
    lists = joined.groupBy("__doc", "__th").agg(F.sort_array(F.collect_list(F.struct(*[F.col(c.removeprefix("__")) for c in FIELDS]))).alias("n"))
    known = checkpoint(lists.select("__doc", "__th", *[F.col(f"n.{c.removeprefix('__')}").alias(c) for c in FIELDS]))

    dealt = base.repartition("__doc", "__th")  # the only shuffle of texts, shared by both passes below
    here = dealt.select("__doc", "__th", "__text").join(known.hint("shuffle_hash"), ["__doc", "__th"])

    def open_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for r in _records(b):
                tokens = word_tokens(words_of(r["__text"]))
                at, end, *rest = _known(r)
                rolled = Rolling(tokens)
                node = attached(rolled, window)
                repeated = np.zeros(len(tokens) + 1, bool)
                repeated[at] = True
                todo = repeated[node]
                lo, hi = verified_spans(r["__doc"], at, end, *rest)
                long = hi - lo >= window
                todo &= ~covered(len(todo), lo[long], hi[long] - window + 1)
                s = np.flatnonzero(todo)
                if len(s):
                    second = Rolling(tokens, BASES[1])
                    parts.append((np.full(len(s), r["__doc"]), np.full(len(s), r["__th"]), s, signed(rolled.slices(s, s + window)), (second.slices(s, s + window) >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            if parts:
                yield pd.DataFrame(dict(zip(("__doc", "__th", "s", "w1", "w2"), [np.concatenate(c) for c in zip(*parts, strict=True)], strict=True)))

    digests = here.mapInPandas(open_windows, "__doc long, __th int, s int, w1 long, w2 int")
    pair = F.struct("w1", "w2").alias("w")
    first = digests.groupBy("w1", "w2").agg(F.min("__doc").alias("first"), F.max("__doc").alias("last")).where("first < last").select(pair, "first")
    repeats = digests.select("__doc", "__th", "s", pair).join(first, "w").where("__doc > first").groupBy("__doc", "__th").agg(F.collect_set("s").alias("__s"))

    whole = dealt.join(known.hint("shuffle_hash"), ["__doc", "__th"], "left").join(repeats.hint("shuffle_hash"), ["__doc", "__th"], "left")
    whole = whole.select("doc_id", *[F.col(f"`{c}`") for c in keep], "__doc", "__text", *FIELDS, "__s")
    types = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", *keep))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {c: [] for c in results}
            for r in _records(b[["__doc", "__text", *FIELDS, "__s"]]):
                words = words_of(r["__text"] or "")
                gone = np.zeros(len(words), bool)
                if r["__at"] is not None:
                    lo, hi = verified_spans(r["__doc"], *_known(r))
                    long = hi - lo >= window
                    lo, hi = lo[long], hi[long]
                    if r["__s"] is not None:
                        lo, hi = np.append(lo, r["__s"]), np.append(hi, np.asarray(r["__s"]) + window)
                    gone = covered(len(words), lo, hi)
                a, z = runs(gone)
                out["kept"].append(b" ".join([w for w, g in zip(words, gone, strict=True) if not g]).decode("utf-8", "surrogatepass") if gone.any() else b" ".join(words).decode("utf-8", "surrogatepass"))
                out["n_words"].append(len(words))
                out["n_removed"].append(int(gone.sum()))
                out["spans"].append([{"start": int(x), "end": int(y)} for x, y in zip(a, z, strict=True)])
            yield pd.concat([b[["doc_id", *keep]].reset_index(drop=True), pd.DataFrame(out)], axis=1)

    return whole.mapInPandas(cut, f"{types}, kept string, n_words long, n_removed long, spans array<struct<start:long,end:long>>")


def digest(docs: DataFrame, window: int = 50) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"), window)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str]], window: int = 50) -> dict[int, tuple[int, int, str]]:
    """The same result for a small table, window by window."""
    words = {d: [w.decode() for w in words_of(t or "")] for d, t in rows}
    first: dict[tuple, int] = {}
    for d in sorted(words):
        for i in range(len(words[d]) - window + 1):
            first.setdefault(tuple(words[d][i : i + window]), d)
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out
