"""Near-duplicate classes by SimHash: tiled exact comparison of all fingerprints by exclusive-or and bit counts.

Equal fingerprints are one.  Different ones are laid out in tiles by the population counts of their parts (``parts`` equal slices of the 64
bits); as each part's count differs by at most the number of its differing bits, tiles whose counts differ by more than the radius in
sum hold no link, and that pair of tiles is skipped.  All other pairs of tiles are compared completely with numpy, so no link is lost and
nothing is approximate.  A pair of tiles returns a spanning forest of its links, never all of them.

The work is quadratic in the number of different fingerprints, divided by what the counts skip; the more parts, the more is skipped, and
the smaller the tiles become.  ``PARTS_FROM`` says how many parts are used from how many fingerprints on; results are the same for any.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismatica.llm.common import checkpoint, connected_components, has_rows, small_batches
from prismatica.llm.rolling import signed

#: Fingerprints in a tile on average; 8 bytes each.
TILE = 8192
#: Parts whose population counts are compared, by the least number of different fingerprints.
PARTS_FROM = ((0, 1), (8_000_000, 2), (64_000_000, 4))
#: Fixed value: the seed of the shingles' hash.
SEED = 42
#: Shingles that are counted together.
CHUNK = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


# ---------------------------------------------------------------------------------------------- fingerprints


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of all shingles, repeats included, of a text whose A-Z are lower-cased; fewer words make one shingle, no words none."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(found) <= words:
        return np.array([xxh64_intdigest(b" ".join(found), SEED)] if found else [], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1])
    return np.fromiter([xxh64_intdigest(joined[a:z], SEED) for a, z in zip(starts.tolist(), ends[words - 1 :].tolist(), strict=True)], np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """Bits that are set in more than half of the hashes."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), CHUNK):
        octets = np.ascontiguousarray(hashes[a : a + CHUNK]).view(np.uint8).reshape(-1, 8)
        if len(octets) < 64:
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            counts += np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, words: int = 4) -> int:
    return majority(shingle_hashes(text, words))


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text") -> DataFrame:
    """The given columns but for the text, and ``fingerprint long``.  A null text and one without words have fingerprint zero."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def made(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(signed(np.array([fingerprint(t, words) for t in texts], np.uint64)))

    return docs.select(*[c for c in docs.columns if c not in (text, "fingerprint")], made(F.col(text).cast("string")).alias("fingerprint"))


# ---------------------------------------------------------------------------------------------- tiles


def cell_of(values: np.ndarray, parts: int) -> np.ndarray:
    """Population counts of the parts, as one number: the digits of a number of base 64 / parts + 1."""
    width, cell = 64 // parts, np.zeros(len(values), np.int64)
    for k in range(parts):
        part = (values >> np.uint64(k * width)) & np.uint64((1 << width) - 1 if width < 64 else 0xFFFFFFFFFFFFFFFF)
        cell = cell * (width + 1) + np.bitwise_count(part)
    return cell


def near_cells(parts: int, radius: int) -> np.ndarray:
    """Differences of population counts, part by part, that add up to at most the radius."""
    return np.array([d for d in product(range(-radius, radius + 1), repeat=parts) if sum(map(abs, d)) <= radius])


class Layout:
    """How many tiles each cell has: at most 65, 1,089 or 83,521 cells for one, two or four parts, however many fingerprints there are."""

    def __init__(self, tiles: dict[int, int], parts: int, radius: int):
        self.tiles, self.parts, self.base = tiles, parts, 64 // parts + 1
        self.near = near_cells(parts, radius)

    def partners(self, cell: int) -> list[int]:
        """Occupied cells within the radius, itself included."""
        digits = np.array([cell // self.base ** (self.parts - 1 - k) % self.base for k in range(self.parts)])
        near = digits + self.near
        near = near[((near >= 0) & (near < self.base)).all(axis=1)]
        return [c for c in (near @ (self.base ** np.arange(self.parts - 1, -1, -1))).tolist() if c in self.tiles]

    def pairs(self, cell: int, tile: int) -> Iterator[tuple[int, int, int, int, bool]]:
        """The pairs of tiles that this one takes part in, each with its smaller side first; whether this is that side."""
        for other in self.partners(cell):
            for k in range(self.tiles[other]):
                if (cell, tile) <= (other, k):
                    yield cell, tile, other, k, True
                if (cell, tile) > (other, k):
                    yield other, k, cell, tile, False


def forest(a: np.ndarray, b: np.ndarray, radius: int, block: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links between two tiles, or inside one (``b`` is ``a``), as two arrays of fingerprints."""
    inside, both = b is a, np.concatenate([a, b])
    label = np.arange(len(both))
    left, right = [], []
    step = max(1, block // max(len(b), 1))
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        close = np.bitwise_count(rows[:, None] ^ b[None, :]) <= radius
        if inside:
            close[np.arange(len(rows)), np.arange(at, at + len(rows))] = False
        if not close.any():
            continue
        for i in np.flatnonzero(close.any(axis=1)).tolist():
            found = np.flatnonzero(close[i]) + (0 if inside else len(a))
            own, first = at + i, label[at + i]
            roots, where = np.unique(label[found], return_index=True)
            new = roots != first
            if new.any():
                left.append(np.full(int(new.sum()), both[own]))
                right.append(both[found[where[new]]])
                label[np.isin(label, roots[new])] = first
    return (np.concatenate(left), np.concatenate(right)) if left else (a[:0], a[:0])


def links(different: DataFrame, radius: int = 4, parts: int | None = None, tile: int = TILE) -> DataFrame:
    """(a, b): links between ``different(fingerprint)`` that join the same fingerprints as all links within the radius do."""
    if parts is None:
        n = different.count()
        parts = max(k for least, k in PARTS_FROM if n >= least)
    width = 64 // parts
    counts = [F.bit_count(F.expr(f"fingerprint & {_literal(k * width, width)}")).cast("long") for k in range(parts)]
    cell = counts[0]
    for c in counts[1:]:
        cell = cell * (width + 1) + c
    celled = different.select("fingerprint", cell.alias("cell"))
    # The counts of all cells go to the driver: their number is bounded by the number of bits.
    layout = Layout({int(r["cell"]): -(-int(r["count"]) // tile) for r in celled.groupBy("cell").count().toLocalIterator()}, parts, radius)
    sizes = celled.groupBy("cell").count().select(F.col("cell").alias("of"), F.ceil(F.col("count") / tile).alias("tiles"))
    dealt = celled.join(F.broadcast(sizes), F.col("cell") == F.col("of")).select("cell", F.pmod(F.xxhash64("fingerprint"), "tiles").alias("tile"), "fingerprint")
    tiles = checkpoint(dealt.groupBy("cell", "tile").agg(F.collect_list("fingerprint").alias("held")))

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for c, t, held in zip(b["cell"], b["tile"], b["held"], strict=True):
                data = np.asarray(held, np.int64).tobytes()
                rows = [(*pair, data) for pair in layout.pairs(int(c), int(t))]
                for at in range(0, len(rows), 64):
                    yield pd.DataFrame(rows[at : at + 64], columns=["c", "t", "d", "u", "first", "data"])

    def compare(key: tuple, pair: pd.DataFrame) -> pd.DataFrame:
        held = {bool(f): np.frombuffer(x, np.uint64) for f, x in zip(pair["first"], pair["data"], strict=True)}
        one = held[True]
        a, b = forest(one, held.get(False, one), radius)
        return pd.DataFrame({"a": signed(a), "b": signed(b)})

    small_batches(different.sparkSession, 64)
    pairs = tiles.mapInPandas(sent, "c long, t long, d long, u long, first boolean, data binary")
    return pairs.groupBy("c", "t", "d", "u").applyInPandas(compare, "a long, b long")


def _literal(shift: int, width: int) -> str:
    mask = ((1 << width) - 1) << shift
    return f"{mask - (1 << 64) if mask >= 1 << 63 else mask}L" if mask != 1 << 63 else "(-9223372036854775807L - 1L)"


def near_classes(docs: DataFrame, words: int = 4, radius: int = 4, id_column: str = "doc_id", text: str = "text", parts: int | None = None, tile: int = TILE) -> DataFrame:
    """One row for each row of ``docs``: id, fingerprint (16 lower-case hexadecimal digits), component_id (least id reachable over links).

    Linked are fingerprints that differ in at most ``radius`` bits.  Texts without words, null ones included, have fingerprint zero and
    are linked like any other.  Rows with the same id count as documents of their own; those with a null id take part, and have a null
    component_id only where no member has an id.  Other columns are left out.  No rows: no rows.
    """
    made = checkpoint(fingerprints(docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text")), words))
    least = checkpoint(made.groupBy("fingerprint").agg(F.min("id").alias("least")))
    found = checkpoint(links(least.select("fingerprint"), radius, parts, tile))
    # The joins' keys are structs that only they use, so that Spark can split a fingerprint that very many documents have.
    if has_rows(found):
        labels = connected_components(found).select(F.col("node").alias("fingerprint"), "label")
        joined = checkpoint(labels.join(least, "fingerprint"))
        first = joined.groupBy("label").agg(F.min("least").alias("component_id")).select(F.struct("label").alias("key"), "component_id")
        linked = joined.select("fingerprint", F.struct("label").alias("key")).join(first, "key").select("fingerprint", "component_id", F.lit(True).alias("linked"))
        known = least.join(linked, "fingerprint", "left").select(F.struct("fingerprint").alias("key"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    else:
        known = least.select(F.struct("fingerprint").alias("key"), F.col("least").alias("component_id"))
    out = made.select("id", "fingerprint", F.struct("fingerprint").alias("key")).join(known, "key")
    return out.select(F.col("id").alias(id_column), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def brute_force(rows: list[tuple[int, str | None]], words: int = 4, radius: int = 4) -> dict[int, tuple[str, int]]:
    """Fingerprint and component of (id, text) rows by counting bit after bit and comparing all pairs; for tests."""
    from xxhash import xxh64_intdigest

    made = {}
    for i, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        grams = [w[k : k + words] for k in range(len(w) - words + 1)] or ([w] if w else [])
        hashes = [xxh64_intdigest(b" ".join(g), SEED) for g in grams]
        made[i] = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    component = {i: i for i in made}
    for i in sorted(made):
        todo = [i]
        while component[i] == i and todo:
            j = todo.pop()
            for k in made:
                if component[k] > i and bin(made[j] ^ made[k]).count("1") <= radius:
                    component[k] = i
                    todo.append(k)
    return {i: (f"{made[i]:016x}", component[i]) for i in made}
