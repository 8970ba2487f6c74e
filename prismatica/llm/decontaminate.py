"""Benchmark decontamination by edit distance over words.

A document leaks an item of m words if some stretch of it is within floor(m / 5) word edits of the item (a similarity of 0.8).  Such a
stretch shares a run of at least ceil((m - k) / (k + 1)) words with the item, so item-sized windows are laid only around shared runs
of that length, which loses none.  Each window is embedded by CGK random walks (edit distance becomes Hamming distance), and repeated
samples of the embedding's coordinates are compared with the item's; windows that agree in any repetition are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatica.llm.common import names_apart, small_batches, unused
from prismatica.llm.rolling import Rolling, mix
from prismatica.llm.substring_dedup import word_tokens

#: Repetitions and sampled coordinates of each, by the most words of an item.  Walks that an edit pushed apart stay apart for long, so
#: coordinates don't differ independently and longer items need fewer in one sample.  Set from measured recall at floor(m / 5) edits
#: (README, notes on exactness).
SAMPLING, WALK = ((30, 128, 2), (None, 64, 1)), 3
#: Words of the items that one pass over the documents holds.
BLOCK_WORDS = 1_000_000
FILTER_BITS = 22


def tokens_of(text: str | None) -> np.ndarray:
    """Words between ASCII white space with A-Z lower-cased, hashed to 64 bits."""
    return word_tokens((text or "").encode("utf-8", "surrogatepass").lower().split())


def sampling(m: int) -> tuple[int, int]:
    """Repetitions, and sampled coordinates of each, for items of m words."""
    return next((r, min(c, m)) for most, r, c in SAMPLING if most is None or m <= most)


@lru_cache(maxsize=256)
def walk(m: int) -> tuple[np.ndarray, np.ndarray]:
    """Seeds of the random walks, and the sampled steps of each repetition, for items of m words."""
    rng = np.random.default_rng(1_000_003 + m)
    repetitions, coordinates = sampling(m)
    seeds = rng.integers(0, 1 << 63, size=(WALK * m, repetitions), dtype=np.uint64)
    sampled = np.zeros((WALK * m, repetitions), bool)
    for r in range(repetitions):
        # The first m steps never run past the end of a window, where all windows look alike.
        sampled[rng.choice(m, size=coordinates, replace=False), r] = True
    return seeds, sampled


def sample_keys(windows: np.ndarray) -> np.ndarray:
    """CGK embedding of each window (row of tokens), reduced to one key of sampled coordinates for each repetition."""
    n, m = windows.shape
    seeds, sampled = walk(m)
    last = int(np.flatnonzero(sampled.any(axis=1))[-1]) + 1
    at = np.zeros((n, seeds.shape[1]), np.int64)
    keys = np.zeros((n, seeds.shape[1]), np.uint64)
    rows = np.arange(n)[:, None]
    for step in range(last):
        symbol = np.where(at < m, windows[rows, np.minimum(at, m - 1)], np.uint64(0))
        with np.errstate(over="ignore"):
            taken = sampled[step]
            if taken.any():
                keys[:, taken] = mix(keys[:, taken] * np.uint64(0x9E3779B97F4A7C15) + symbol[:, taken])
            at += ((mix(symbol + seeds[step]) >> np.uint64(40)) & np.uint64(1)).astype(np.int64)
    return keys


def closest_stretch(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of the region, and the end of the first such stretch."""
    n = len(region)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, word in enumerate(item, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[1:] + 1, row[:-1] + (region != word))
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]), end


class Items:
    """One block of benchmark items, with their shared-run seeds."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, tokens_of(t)) for i, t in items]
        self.items = [(i, t) for i, t in self.items if len(t)]
        self.edits = [len(t) // 5 for _, t in self.items]
        seeds: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
        for number, (_, t) in enumerate(self.items):
            k = self.edits[number]
            q = min(8, -(-(len(t) - k) // (k + 1)))
            grams = Rolling(t).windows(q)
            seeds.setdefault(q, []).append((grams, np.full(len(grams), number), np.arange(len(grams))))
        self.seeds = {}
        for q, parts in seeds.items():
            gram, number, offset = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.argsort(gram, kind="stable")
            quick = np.zeros(1 << FILTER_BITS, bool)
            quick[gram >> np.uint64(64 - FILTER_BITS)] = True
            self.seeds[q] = gram[order], number[order], offset[order], quick
        self.keys: dict[int, np.ndarray] = {}

    def shared_runs(self, tokens: np.ndarray) -> dict[int, set[int]]:
        """For each item with a shared run, the window starts that line it up."""
        found: dict[int, set[int]] = {}
        rolled = Rolling(tokens)
        for q, (gram, number, offset, quick) in self.seeds.items():
            own = rolled.windows(q)
            at = np.flatnonzero(quick[own >> np.uint64(64 - FILTER_BITS)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(gram, own[at], "left"), np.searchsorted(gram, own[at], "right")
            for p, a, z in zip(at[hi > lo], lo[hi > lo], hi[hi > lo], strict=True):
                for j in range(a, z):
                    found.setdefault(int(number[j]), set()).add(int(p) - int(offset[j]))
        return found

    def leaks(self, tokens: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item id, start, end, edits) of the items that a document leaks."""
        out = []
        for number, diagonals in sorted(self.shared_runs(tokens).items()):
            item_id, item = self.items[number]
            m, k = len(item), self.edits[number]
            starts = sorted({s for d in diagonals for s in range(d - k, d + k + 1) if -k <= s <= len(tokens) - m + k})
            if number not in self.keys:
                self.keys[number] = sample_keys(item[None, :])[0]
            padded = np.concatenate([np.zeros(k, np.uint64), tokens, np.zeros(m + k, np.uint64)])
            best = None
            for at in range(0, len(starts), 256):
                if best is not None and best[3] == 0:
                    break
                block = np.array(starts[at : at + 256])
                windows = padded[(block + k)[:, None] + np.arange(m)]
                hit = (sample_keys(windows) == self.keys[number]).any(axis=1)
                for s in _spread_out(block[hit], m):
                    # A window's stretch may start up to 2k words away from it.
                    lo, hi = max(0, s - 2 * k), min(len(tokens), s + 2 * m + 3 * k)
                    edits, end = closest_stretch(item, tokens[lo:hi])
                    if edits <= k and (best is None or edits < best[3]):
                        _, back = closest_stretch(item[::-1], tokens[lo : lo + end][::-1])
                        best = (item_id, lo + end - back, lo + end, edits)
            if best is not None:
                out.append(best)
        return out


def _spread_out(starts: np.ndarray, m: int) -> list[int]:
    """One start for all that lie within m of it: the stretch verified from it holds their windows."""
    kept: list[int] = []
    for s in starts.tolist():
        if not kept or s > kept[-1] + m - 1:
            kept.append(s)
    return kept


@names_apart(named=("leaks",))
def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", leaks: str = "leaks") -> DataFrame:
    """Every row with leaks: array of (item_id, start, end, edits), word positions, one for each leaked item, end exclusive.

    A null text has no words and leaks nothing.  Items of fewer than 5 words leak where they occur unchanged; null ones and
    those without words never do; repeated items are all reported; of equally close stretches the first counts.  A column named as
    the result is replaced.
    Items are held in blocks of at most BLOCK_WORDS words (or one longer item), one row-local pass over the documents for each block.
    """
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null")
    size = items.agg(F.sum(F.length("text") / 2)).first()[0] or 0
    blocks = max(1, int(-(-size // BLOCK_WORDS)))
    empty = F.array().cast("array<struct<item_id:long,start:long,end:long,edits:int>>")
    out = docs.withColumn(leaks, empty)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    for block in range(blocks):
        held = [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()]

        def find(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            these = Items(held)
            for b in batches:
                found = [these.leaks(tokens_of(t)) for t in b[text]]
                b[leaks] = [[*(dict(x) for x in old), *(dict(zip(("item_id", "start", "end", "edits"), x, strict=True)) for x in new)] for old, new in zip(b[leaks], found, strict=True)]
                yield b

        out = out.mapInPandas(find, schema)
    return out


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of every leak."""
    found = with_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any leak, as they are."""
    leaks = unused(docs, "leaks")
    return with_leaks(docs, benchmark, leaks=leaks).where(F.size(leaks) == 0).drop(leaks)
