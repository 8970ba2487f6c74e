"""Approximate nearest neighbours by cross-polytope hashing with exact reranking.

A hash of a unit vector applies fast Hadamard pseudo-rotations (random signs and a Walsh-Hadamard transform, three times) and takes the
nearest signed axis.  A cell of a table joins several hashes, more of them the more vectors there are, so that a probe meets a bounded
number of members.  Every vector lies in one cell of each table; a query probes the cells that cost least, by how much nearer the
nearest axes are.  Members and queries are sent by all but the last hash, and meet there only where the whole cell agrees; a crowded
part becomes many blocks, none of them large, and none of its members is left out.  Equal vectors are one member with its smallest ids.

Vectors are hashed whatever their number.  Hashing finds near neighbours, but a far one only by chance; so queries that found fewer than
asked for are then compared with all members of their length, in the same blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismatica.llm.common import checkpoint

#: Joined hashes of a cell: tables, probed cells of each, and nearest axes of each hash that probes combine.  On 51,282 vectors of 64
#: components, half of whose five nearest have cosines under 0.47, two hashes find 0.95 of them and compare a query with 0.14 of all
#: vectors; three find 0.94 and compare it with 0.07.  More vectors have nearer neighbours, which are found more often.
PLANS = {1: (16, 6, 6), 2: (16, 96, 32), 3: (20, 3072, 16)}
#: Members that a whole cell may hold on average before one more hash is joined.
CELL = 64
#: Members and queries of one block of a cell.
BLOCK = 2048
#: Pairs that a block scores at once.
PAIRS = 100_000
SEED = 11


def rotations(width: int, tables: int, seed: int = SEED) -> np.ndarray:
    """Random signs of the three rounds of each table."""
    return np.random.default_rng(seed).choice([-1.0, 1.0], size=(tables, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the last axis, whose length is a power of two, scaled to keep lengths."""
    n = x.shape[-1]
    step = 1
    while step < n:
        pairs = x.reshape(*x.shape[:-1], n // (2 * step), 2, step)
        x = np.stack([pairs[..., 0, :] + pairs[..., 1, :], pairs[..., 0, :] - pairs[..., 1, :]], axis=-2).reshape(x.shape)
        step *= 2
    return x / np.sqrt(n)


def rotated(vectors: np.ndarray, signs: np.ndarray) -> np.ndarray:
    width = signs.shape[-1]
    x = np.zeros((len(vectors), width))
    x[:, : vectors.shape[1]] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    for s in signs:
        x = hadamard(x * s)
    return x


def hashes(members: int, axes: int) -> int:
    """Joined hashes of a cell for so many members, of rotations with so many signed axes."""
    k = 1
    while k < max(PLANS) and members > CELL * axes**k:
        k += 1
    return k


def cells(turned: list[np.ndarray], probes: int, nearest_axes: int) -> np.ndarray:
    """Numbers of the cheapest cells by all hashes, cheapest first; axis i is 2i, or 2i + 1 if negative."""
    code = cost = None
    n, axes = len(turned[0]), 2 * turned[0].shape[1]
    for x in turned:
        both = np.abs(x)
        order = np.argsort(-both, axis=1, kind="stable")[:, : min(nearest_axes, x.shape[1])]
        near = np.take_along_axis(both, order, 1)
        axis, off = 2 * order + (np.take_along_axis(x, order, 1) < 0), (near[:, :1] - near) ** 2
        code, cost = (axis, off) if code is None else ((code[:, :, None] * axes + axis[:, None, :]).reshape(n, -1), (cost[:, :, None] + off[:, None, :]).reshape(n, -1))
    if probes < code.shape[1]:
        code = np.take_along_axis(code, np.argsort(cost, axis=1, kind="stable")[:, :probes], 1)
    return code


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank from 1, id_column, score) of each query's k nearest found by cosine in double precision, ties to smaller ids.

    ``vectors`` and ``queries`` both have an id and an array column.  A query's own id is no candidate.  Vectors that are null, zero,
    or hold null or non-finite components take no part, nor do rows with a null id; vectors of different length never meet.  Of
    repeated rows (same id and vector) one counts.  A query is compared with the vectors in its cells, or with all of its length where
    its cells hold fewer than k.  So a query gets fewer than k only where there are no more.
    """
    # Single-precision vectors travel as such; all computation is in double precision.
    single = all(d.schema[column].dataType.simpleString() == "array<float>" for d in (vectors, queries))
    kind = "array<float>" if single else "array<double>"
    usable = lambda d: d.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast(kind).alias("x")).where(
        "id is not null and x is not null and size(x) > 0 and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity')) and exists(x, v -> v <> 0)"
    )
    # One member for equal vectors, with the k + 1 least ids (one may be the query's own).
    least = Window.partitionBy("x").orderBy("id")
    members = usable(vectors).distinct().withColumn("n", F.row_number().over(least)).where(F.col("n") <= k + 1)
    members = checkpoint(members.groupBy("x").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    # Equal query vectors ask once; the least id stands for them until the end.
    every = usable(queries).distinct()
    asked = every.groupBy("x").agg(F.array(F.min("id")).alias("ids"))
    # Two numbers for each length that vectors have.
    large = {r[0]: r[1] for r in members.groupBy(F.size("x").alias("width")).count().collect()}

    def dealt(asking: bool, hashed: dict[int, int]):
        """Rows (cell, salt, fine, x, ids): all but the last hash, and the last hashes of the cells there."""

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for width, same in b.groupby(b["x"].map(len)):
                    own = same["ids"].map(lambda i: i[0]).to_numpy(np.int64)
                    xs, ids = same["x"].to_numpy(), same["ids"].to_numpy()
                    if width not in hashed:
                        # One cell for the whole length, with a number that no hashed cell has.
                        yield pd.DataFrame({"cell": np.full(len(same), -np.int64(width)), "salt": _spread(own, 0), "fine": [[0]] * len(same), "x": xs, "ids": ids})
                        continue
                    x = np.stack(xs).astype(float)
                    size = 1 << max(0, int(width) - 1).bit_length()
                    joined = hashes(hashed[width], 2 * size)
                    tables, probes, axes = PLANS[joined]
                    split = 2 * size if joined > 1 else 1
                    signs = rotations(size, tables * joined)
                    for t in range(tables):
                        found = cells([rotated(x, signs[t * joined + h]) for h in range(joined)], probes if asking else 1, axes if asking else 1)
                        coarse, fine = found // split, found % split
                        if asking:  # one row for each part that a query enters, with all its cells there
                            row = np.repeat(np.arange(len(x)), found.shape[1])
                            order = np.lexsort((coarse.ravel(), row))
                            cell = coarse.ravel()[order]
                            starts = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (cell[1:] != cell[:-1])))
                            row, cell, last = row[starts], cell[starts], np.split(fine.ravel()[order], starts[1:])
                        else:
                            row, cell, last = np.arange(len(x)), coarse[:, 0], list(fine)
                        number = (np.int64(width) * max(p[0] for p in PLANS.values()) + t) * (2 * size) ** max(1, joined - 1) + cell
                        yield pd.DataFrame({"cell": number, "salt": _spread(own[row], t), "fine": last, "x": xs[row], "ids": ids[row]})

        return run

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        asks = block["asks"].to_numpy()
        members_, queries_ = block[~asks], block[asks]
        parts = []
        if len(members_) and len(queries_):
            fine = np.array([f[0] for f in members_["fine"]])
            order = np.argsort(fine, kind="stable")
            fine, x, ids = fine[order], np.stack(members_["x"].to_numpy()[order]).astype(float), members_["ids"].to_numpy()[order]
            first, norms = np.array([i[0] for i in ids]), np.sqrt((x * x).sum(axis=1))
            qx, asking = np.stack(queries_["x"].to_numpy()).astype(float), np.array([i[0] for i in queries_["ids"]])
            q_norms = np.sqrt((qx * qx).sum(axis=1))
            wanted = queries_["fine"].to_numpy()
            of, flat = np.repeat(np.arange(len(wanted)), [len(w) for w in wanted]), np.concatenate(wanted)
            lo, hi = np.searchsorted(fine, flat, "left"), np.searchsorted(fine, flat, "right")
            of, lo, n = of[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            per = np.bincount(of, weights=n, minlength=len(wanted)).astype(np.int64)
            upto = np.cumsum(per)
            at = 0
            while at < len(wanted):  # queries whose pairs fit into PAIRS, or one query
                to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
                use = (of >= at) & (of < to)
                q, count = np.repeat(of[use], n[use]), n[use]
                m = np.repeat(lo[use] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum()) if len(count) else np.empty(0, np.int64)
                # A sum along the components, the same for a pair in whatever block it meets.
                score = (x[m] * qx[q]).sum(axis=1) / (norms[m] * q_norms[q])
                best = np.lexsort((first[m], -score, q))
                q, m, score = q[best], m[best], score[best]
                keep = np.arange(len(q)) - np.searchsorted(q, q, "left") <= k
                parts.append(pd.DataFrame({"query": asking[q[keep]], "score": score[keep], "ids": ids[m[keep]]}))
                at = to
        return pd.concat(parts) if parts else pd.DataFrame({"query": np.empty(0, np.int64), "score": np.empty(0), "ids": []})

    order = [F.desc("score"), F.asc("id")]
    schema = f"cell long, salt long, fine array<long>, x {kind}, ids array<long>"

    def tops(members: DataFrame, asked: DataFrame, hashed: dict[int, int]) -> DataFrame:
        """(query, id, score) of the k + 1 best that each query meets; vectors of other lengths than the hashed ones all meet."""
        in_cells = members.mapInPandas(dealt(False, hashed), schema)
        probing = asked.mapInPandas(dealt(True, hashed), schema)
        counts = checkpoint(
            in_cells.groupBy("cell").agg(F.count("*").alias("n")).join(probing.groupBy("cell").agg(F.count("*").alias("m")), "cell").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("mb"), F.ceil(F.col("m") / BLOCK).cast("int").alias("qb"))
        )
        a = in_cells.join(counts, "cell").select("cell", F.pmod("salt", "mb").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("qb") - 1)).alias("j"), F.lit(False).alias("asks"), "fine", "x", "ids")
        q = probing.join(counts, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("i"), F.pmod("salt", "qb").cast("int").alias("j"), F.lit(True).alias("asks"), "fine", "x", "ids")
        met = a.unionByName(q).groupBy("cell", "i", "j").applyInPandas(compare, "query long, score double, ids array<long>")
        met = met.select("query", "score", F.explode("ids").alias("id")).groupBy("query", "id").agg(F.max("score").alias("score"))
        return met.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("n") <= k + 1).select("query", "id", "score")

    found = tops(members, asked, large)
    if large:
        found = checkpoint(found)
        # One of k + 1 may be the query's own id.
        enough = found.groupBy("query").count().where(F.col("count") > k)
        short = checkpoint(asked.where(F.size("x").isin(list(large))).withColumn("query", F.col("ids")[0]).join(enough, "query", "left_anti"))
        lengths = [r[0] for r in short.select(F.size("x")).distinct().collect()]
        if lengths:
            more = tops(members.where(F.size("x").isin(lengths)), short.select("x", "ids"), {})
            found = found.join(short, "query", "left_anti").unionByName(more)
    asking = every.join(asked.select("x", F.col("ids")[0].alias("query")), "x").select("query", F.col("id").alias("query_id"))
    found = asking.join(found, "query").where("id <> query_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_column), "score")


def _spread(ids: np.ndarray, table: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((ids.astype(np.uint64) + np.uint64(table)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
