"""Periodic runs of words: Lyndon arrays by Baier's grouping under both orders, Lyndon roots extended through LCE.

Phase one of Baier's suffix sorter orders all suffixes by the longest Lyndon word at their start, one group for each such word, so the
length of a group's word is the Lyndon array.  Groups are finished from the highest down: each position that leaves gives its word to
the nearest position on its left that is still there, whose own word then ends just before it.  Every run has a Lyndon root under one
of the two orders that stands in it twice in a row; from there it is extended in both directions as long as words a period apart agree.

Words are grouped only where a run can be: in a run of at least three periods and 24 words every window of 8 words occurs again in the
same text, so stretches covered by such windows hold all runs whole.  Digests only choose the stretches; what is grouped, compared and
extended are the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatica.llm.common import names_apart, small_batches
from prismatica.llm.rolling import Rolling, covered, mix, runs

#: Fixed values of a run: least words, and least periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of a window that must occur twice, and words that must agree a period apart after the first root of a run.
SEED, AGREE = 8, 9
#: Words that are handled together; a longer text is handled alone.
BLOCK_WORDS = 150_000
WORD = r"[^\x20\x09-\x0D]+"


def lyndon_array(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word at each position; negative symbols separate sequences, get 0, and must stand first and last."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    order = order[np.searchsorted(symbols[order], 0) :]
    if not len(order):
        return np.zeros(n, np.int64)
    cuts = np.flatnonzero(np.diff(symbols[order])) + 1
    members = [x.tolist() for x in np.split(order, cuts)]
    alive = [len(m) for m in members]
    size = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group = np.full(n, -1)
    group[order] = np.repeat(np.arange(len(members)), alive)
    group = group.tolist()
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    out = [0] * n
    g = len(members) - 1
    while g >= 0:
        length, hit = size[g], []
        for i in members[g]:
            if group[i] == g:
                p, f = left[i], right[i]
                right[p] = f
                left[f] = p
                out[i] = length
                if group[p] >= 0:
                    hit.append(p)
        members[g] = None
        for h, moved, length_more in _longer(hit, group, length):
            if len(moved) == alive[h]:
                size[h] += length_more
                continue
            new, over = len(size), above[h]
            alive[h] -= len(moved)
            members.append(moved)
            alive.append(len(moved))
            size.append(size[h] + length_more)
            below.append(h)
            above.append(over)
            above[h] = new
            if over < len(below):
                below[over] = new
            for p in moved:
                group[p] = new
        g = below[g]
    return np.array(out, np.int64)


def _longer(hit: list[int], group: list[int], length: int) -> list[tuple[int, list[int], int]]:
    """Positions whose word grows, by their group; those that grow by more copies come first, as they sort higher."""
    if len(hit) == 1:
        return [(group[hit[0]], hit, length)]
    times: dict[int, int] = {}
    for p in hit:
        times[p] = times.get(p, 0) + 1
    parts: dict[tuple[int, int], list[int]] = {}
    for p, k in times.items():
        parts.setdefault((-k, group[p]), []).append(p)
    if len(parts) == 1:
        ((k, h), moved) = next(iter(parts.items()))
        return [(h, moved, -k * length)]
    return [(h, moved, -k * length) for (k, h), moved in sorted(parts.items())]


def extension(x: np.ndarray, i: int, j: int, step: int) -> int:
    """How many symbols from i and from j on agree, rightwards (step 1) or leftwards (-1); i < j, and a separator ends them."""
    done, block = 0, 32
    while True:
        size = min(block, len(x) - j - done if step > 0 else i - done + 1)
        if size <= 0:
            return done
        if step > 0:
            differ = np.flatnonzero(x[i + done : i + done + size] != x[j + done : j + done + size])
        else:
            differ = np.flatnonzero(x[i - done - size + 1 : i - done + 1][::-1] != x[j - done - size + 1 : j - done + 1][::-1])
        if len(differ):
            return done + int(differ[0])
        done += size
        block *= 2


def roots(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and starts, in this order, of Lyndon roots that stand twice in a row and may belong to a run."""
    top, starts, periods = int(x.max(initial=0)), [], []
    for symbols in (x, np.where(x < 0, x, top - x)):
        lyndon = lyndon_array(symbols)
        at = np.flatnonzero(lyndon)
        period = lyndon[at]
        keep = lyndon[at + period] == period  # a separator stands last and is no word's start
        at, period = at[keep], period[keep]
        for k in range(AGREE):
            ahead = np.minimum(at + period + k, len(x) - 1)
            keep = x[at + k] == x[ahead]
            at, period = at[keep], period[keep]
        starts.append(at)
        periods.append(period)
    at, period = np.concatenate(starts), np.concatenate(periods)
    order = np.lexsort((at, period))
    return period[order], at[order]


def runs_of(x: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of separated sequences, by start, then period."""
    found, last, upto = [], 0, 0
    period, at = roots(x)
    for p, i in zip(period.tolist(), at.tolist(), strict=True):
        if p == last and i < upto:  # of the stretch that was extended from a root before
            continue
        last, upto = p, i + extension(x, i, i + p, 1)
        if upto - i < p:
            continue  # two words of the same length that differ
        start = i - extension(x, i - 1, i + p - 1, -1)
        if upto + p - start >= max(LEAST_WORDS, LEAST_PERIODS * p):
            found.append((start, upto + p - start, p))
    return sorted(found)


def block_runs(texts: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text, given as word numbers."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    stop = np.full(1, -1, np.int64)
    x = np.concatenate([stop, *(part for t in texts for part in (t, stop))])
    starts = np.cumsum([1, *(len(t) + 1 for t in texts)])[: len(texts)]
    if len(x) < LEAST_WORDS:
        return out
    of = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    of = np.concatenate([[0], of]).astype(np.uint64)
    with np.errstate(over="ignore"):
        windows = Rolling(mix((x + 2).astype(np.uint64))).windows(SEED)
        windows = mix(windows ^ (of[: len(windows)] * np.uint64(0x9E3779B97F4A7C15)))
    inside = np.flatnonzero(np.convolve(x < 0, np.ones(SEED, np.int64), "valid") == 0)
    order = inside[np.argsort(windows[inside])]
    same = windows[order[1:]] == windows[order[:-1]]
    twice = np.zeros(len(x), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    begin = np.flatnonzero(twice)
    s, e = runs(covered(len(x), begin, begin + SEED))
    keep = e - s >= LEAST_WORDS
    s, e = s[keep], e[keep]
    if not len(s):
        return out
    # A stretch never holds a separator, so two texts' stretches have one between them.
    at = np.concatenate([np.arange(a - 1, b) for a, b in zip(s.tolist(), e.tolist(), strict=True)])
    held = x[at]
    held[np.cumsum(np.concatenate([[0], (e - s + 1)[:-1]]))] = -1
    for start, length, period in runs_of(np.concatenate([held, stop])):
        place = int(at[start])
        k = int(of[place])
        out[k].append((place - int(starts[k]), length, period))
    return out


def collapse(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The words that stay, joined by one space: of each run only its first period, unless another run drops those too."""
    if not found:
        return b" ".join(words)
    gone = covered(len(words), np.array([s + p for s, _, p in found]), np.array([s + n for s, n, _ in found]))
    return b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])


def _found(texts: pd.Series) -> pd.DataFrame:
    split = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
    rows: list[tuple] = []
    at = 0
    while at < len(split):
        upto, held = at, 0
        while upto < len(split) and (upto == at or held + len(split[upto]) <= BLOCK_WORDS):
            held += len(split[upto])
            upto += 1
        numbers: dict[bytes, int] = {}
        coded = [np.fromiter([numbers.setdefault(w, len(numbers)) for w in words], np.int64, len(words)) for words in split[at:upto]]
        for words, found in zip(split[at:upto], block_runs(coded), strict=True):
            rows.append((len(words), [r[0] for r in found], [r[1] for r in found], [r[2] for r in found], collapse(words, found).decode("utf-8", "surrogatepass")))
        at = upto
    return pd.DataFrame(rows, columns=["n_words", "start", "length", "period", "collapsed"])


@names_apart(replaced=("n_words", "runs", "collapsed"))
def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, runs (array of start, length, period; by start, then period) and collapsed (kept words joined by one space).

    A run is a maximal stretch of at least 24 words and three smallest periods.  Row-local: nothing is shuffled, rows are neither
    joined nor compared, so ids may be null and repeated.  A null text has no words, no runs and an empty collapsed text.  Given
    columns of the results' names are replaced; all others stay.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_words long, start array<long>, length array<long>, period array<long>, collapsed string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield _found(texts)

    made = docs.withColumn("__found", found(F.col(text).cast("string")))
    zipped = F.arrays_zip(F.col("__found.start").alias("start"), F.col("__found.length").alias("length"), F.col("__found.period").alias("period"))
    return made.select(*docs.columns, F.col("__found.n_words").alias("n_words"), zipped.alias("runs"), F.col("__found.collapsed").alias("collapsed"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every text whose id has a checksum h divisible by ten repeats a part of itself to its end.

    With g = floor(h / 10) and n words, word i from a = g % n on becomes word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)).
    Texts with a null id, and without words, stay as they are.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    made = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, words).alias("w"))
    made = made.select("doc_id", "text", "w", F.expr("h div 10 as g"), F.size("w").alias("n")).withColumn("a", F.expr("if(n > 0, g % n, 0)"))
    repeated = F.expr("array_join(transform(sequence(0, n - 1), i -> w[int(if(i < a, i, a + (i - a) % (1 + (n - a) div (3 + g % 8))))]), ' ')")
    return made.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's digests of ``periodic_runs`` over ``with_repeats``: one row for each row of ``docs(doc_id, text)``."""
    made = periodic_runs(with_repeats(docs))
    best = F.expr("aggregate(runs, get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    made = made.select("doc_id", F.size("runs").cast("long").alias("n_runs"), F.when(F.size("runs") > 0, best).alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return made.select("doc_id", "n_runs", "best.start", "best.length", "best.period", F.expr("best.length * 1000 div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def brute_force(words: list, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """All runs of one text by trying every period; for tests."""
    found, n = [], len(words)
    for p in range(1, n // least_periods + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(least_words, least_periods * p) and not any(s <= i and i + (j - i + p) <= s + m for s, m, q in found if q < p):
                found.append((i, j - i + p, p))
            i = max(j, i + 1)
    return sorted(found)
