"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; its features are measures of its own text and of the lines before and after it.  Forward-backward gives
each line's marginal; their length-weighted mean, calibrated on the training rows, is the document's score.

Training takes a bounded sample: labelled documents of any length by the hash of their text, ``SAMPLE`` of them, or as many of those
as have ``SAMPLE_CHARS`` characters together.  Lines first take their document's label; then lines of bad documents that the field finds good are labelled anew and the
field is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismatica.llm.common import names_apart, small_batches
from prismatica.llm.rolling import Rolling, mix

SAMPLE, SAMPLE_CHARS, ROUNDS, STEPS, RIDGE = 2000, 50_000_000, 3, 120, 1e-3
THRESHOLD = 0.3
#: Characters of texts whose lines are measured at once; arrays of several words a byte stay small.
BLOCK_CHARS = 400_000

UPPER, LOWER, DIGIT, SPACE, BANG, BAR, SYMBOL, STOP, OTHER = range(9)


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    for kind, chars in ((UPPER, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (LOWER, "abcdefghijklmnopqrstuvwxyz"), (DIGIT, "0123456789"), (SPACE, " \t\n\r\v\f"), (BANG, "!?"), (BAR, "|"), (SYMBOL, "*%$#&@~^_+=<>{}[]\\/"), (STOP, ".,;:")):
        for c in chars:
            out[ord(c)] = kind
    out[128:] = LOWER
    return out


CLASSES = _classes()
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
NAMES = ("upper", "bangs", "bars", "symbols", "digits", "same_word", "same_line", "words", "word_length", "stops", "blank")


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of at most BLOCK_CHARS characters, or one longer text."""
    at = 0
    while at < len(texts):
        size, to = 0, at
        while to < len(texts) and (to == at or size + len(texts[to]) <= BLOCK_CHARS):
            size += len(texts[to])
            to += 1
        yield texts[at:to]
        at = to


def all_line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``line_features`` of any number of texts, block by block."""
    parts, before = [], 0
    for block in blocks(texts):
        x, doc, length = line_features(block)
        parts.append((x, doc + before, length))
        before += len(block)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features with those of the neighbouring lines, number of the text, and length of every line; an empty text has one empty line."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    starts = np.append(0, ends[:-1] + 1)
    doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]) - 1, ends)
    kinds = CLASSES[data]
    count = [np.add.reduceat((kinds == k).view(np.int8), starts, dtype=np.int32).astype(float) for k in range(OTHER)]
    length = (ends - starts).astype(float)
    space = kinds == SPACE
    begins = np.flatnonzero(~space & np.append(True, space[:-1]))
    stops = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    rolled = Rolling(BYTES[data])
    line_of_word = np.searchsorted(ends, begins)
    digest = rolled.slices(begins, stops)
    again = np.zeros(len(begins), bool)
    again[1:] = (digest[1:] == digest[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    words = np.bincount(line_of_word, minlength=len(ends)).astype(float)
    repeated = np.bincount(line_of_word, weights=again, minlength=len(ends))
    with np.errstate(over="ignore"):
        lines = mix(rolled.slices(starts, ends) + doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    _, back, copies = np.unique(lines, return_inverse=True, return_counts=True)
    some = np.maximum(words, 1)
    own = np.stack(
        [
            count[UPPER] / (count[UPPER] + count[LOWER] + 1),
            np.minimum(count[BANG] / some, 3),
            np.minimum(count[BAR] / some, 3),
            np.minimum(count[SYMBOL] / some, 3),
            count[DIGIT] / (length + 1),
            repeated / some,
            np.where(words > 2, np.minimum(np.log(copies[back]), 3), 0),
            np.log1p(words) / 4,
            np.minimum(length / some, 40) / 10,
            np.minimum(count[STOP] / some, 3),
            (words == 0).astype(float),
        ],
        axis=1,
    )
    first, last = np.append(True, doc[1:] != doc[:-1]), np.append(doc[1:] != doc[:-1], True)
    before, after = np.roll(own, 1, axis=0), np.roll(own, -1, axis=0)
    before[first], after[last] = 0, 0
    return np.hstack([own, before, after, first[:, None], last[:, None], np.ones((len(own), 1))]), doc, length + 1


class Chains:
    """Sequences of lines side by side, longest first, so that one step of the chain is one array operation."""

    def __init__(self, doc: np.ndarray, n: int):
        counts = np.bincount(doc, minlength=n)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        order = np.argsort(-counts, kind="stable")
        counts, starts = counts[order], starts[order]
        longest = int(counts[0]) if n else 0
        active = np.searchsorted(-counts, -np.arange(longest), side="left")
        self.steps = [starts[:a] + t for t, a in enumerate(active)]

    def marginals(self, unary: np.ndarray, move: np.ndarray, gradient: bool = False):
        """P(good) of each line, and the expected transitions if asked for.  ``move`` holds positive weights from state to state."""
        good = 1 / (1 + np.exp(-np.clip(unary, -30, 30)))
        psi = np.stack([1 - good, good], axis=1)
        alpha, beta = np.empty_like(psi), np.ones_like(psi)
        for t, at in enumerate(self.steps):
            a = psi[at] if t == 0 else psi[at] * (alpha[self.steps[t - 1][: len(at)]] @ move)
            alpha[at] = a / a.sum(axis=1, keepdims=True)
        pairs = np.zeros((2, 2))
        for t in range(len(self.steps) - 1, 0, -1):
            at = self.steps[t]
            before = self.steps[t - 1][: len(at)]
            onward = psi[at] * beta[at]
            b = onward @ move.T
            beta[before] = b / b.sum(axis=1, keepdims=True)
            if gradient:
                joint = alpha[before][:, :, None] * move * onward[:, None, :]
                pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        both = alpha * beta
        return both[:, 1] / both.sum(axis=1), pairs


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    move: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def means(self, texts: list[str]) -> np.ndarray:
        """Length-weighted mean of the line marginals of each text."""
        x, doc, length = line_features(texts)
        p, _ = Chains(doc, len(texts)).marginals((x - self.mean) / self.scale @ self.weights, np.exp(self.move))
        return np.bincount(doc, weights=p * length, minlength=len(texts)) / np.bincount(doc, weights=length, minlength=len(texts))

    def score(self, texts: list[str]) -> np.ndarray:
        out = [self.calibrated(self.means(block)) for block in blocks(texts)]
        return np.concatenate(out) if out else np.empty(0)

    def calibrated(self, means: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * _logit(means) + self.offset, -30, 30)))


def _logit(p: np.ndarray) -> np.ndarray:
    return np.log((p + 1e-3) / (1 - p + 1e-3))


def _ascend(x: np.ndarray, y: np.ndarray, chains: Chains, doc: np.ndarray, model: Model, steps: int) -> None:
    """Maximises the field's likelihood of line labels y by Adam steps, from the model's weights on."""
    inside = np.flatnonzero(doc[1:] == doc[:-1])
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[inside], y[inside + 1]), 1)
    theta = np.concatenate([model.weights, model.move.ravel()])
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), len(y)
    for step in range(1, steps + 1):
        p, pairs = chains.marginals(x @ theta[:-4], np.exp(theta[-4:].reshape(2, 2)), gradient=True)
        g = np.concatenate([x.T @ (y - p), (seen - pairs).ravel()]) / n - RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    model.weights, model.move = theta[:-4], np.clip(theta[-4:].reshape(2, 2), -8, 8)


def train(texts: list[str], quality: list[int]) -> Model:
    """Fits the field and the calibration; without rows of both labels every score is the share of good labels (0.5 without any)."""
    width = 3 * len(NAMES) + 3
    model = Model(np.zeros(width), np.ones(width), np.zeros(width), np.zeros((2, 2)))
    label = np.asarray(quality, int)
    if len(set(quality)) < 2:
        share = float(label.mean()) if len(label) else 0.5
        model.slope, model.offset = 0.0, float(_logit(np.array([share]))[0])
        return model
    x, doc, length = all_line_features(texts)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    model.mean[-1], model.scale[-1] = 0, 1
    x = (x - model.mean) / model.scale
    chains, y = Chains(doc, len(texts)), label[doc]
    for again in range(ROUNDS):
        _ascend(x, y, chains, doc, model, STEPS)
        p, _ = chains.marginals(x @ model.weights, np.exp(model.move))
        if again < ROUNDS - 1:
            worst = np.full(len(texts), np.inf)
            np.minimum.at(worst, doc, p)
            y = np.where(label[doc] == 1, 1, ((p > 0.5) & (p > worst[doc])).astype(int))
    z = _logit(np.bincount(doc, weights=p * length) / np.bincount(doc, weights=length))
    slope = offset = 0.0
    for _ in range(25):  # Newton steps of the one-variable logistic fit, with a light ridge
        q = 1 / (1 + np.exp(-np.clip(slope * z + offset, -30, 30)))
        w = q * (1 - q) + 1e-6
        g = np.array([((label - q) * z).sum() - 0.1 * slope, (label - q).sum()])
        h = np.array([[(w * z * z).sum() + 0.1, (w * z).sum()], [(w * z).sum(), w.sum()]])
        ds, do = np.linalg.solve(h, g)
        slope, offset = slope + float(np.clip(ds, -2, 2)), offset + float(np.clip(do, -2, 2))
    model.slope, model.offset = slope, offset
    return model


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Trains on rows that are not held out.  Labels other than 0 and 1, and null texts, are left out; of several labels for one
    document the least counts."""
    chosen = labels.where(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ids = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * sample)  # a bounded sample of labelled rows
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    order = [F.xxhash64("text"), F.col("doc_id")]
    rows = texts.join(F.broadcast(ids), "doc_id").orderBy(*order).limit(sample)
    held = F.sum(F.length("text")).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over the sample only
    rows = rows.withColumn("held", held).where(F.col("held") <= SAMPLE_CHARS).select("text", "quality").collect()
    return train([r[0] for r in rows], [int(r[1]) for r in rows])


@names_apart(named=("column",))
def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """Every row with its score; null and empty texts score as one empty line.  A column named as the result is replaced.  Row-local."""
    small_batches(docs.sparkSession)
    keep = docs.drop(column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema) + f", `{column}` double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b[column] = model.score([t or "" for t in b["text"]])
            yield b

    return keep.mapInPandas(run, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    scored = score(docs.select("doc_id", F.col("text").cast("string").alias("text")), fit(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
