"""The order in which a view's fields are worked on: dependencies first, and batches of bounded size that keep related names together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismatica.functions.naming import references
from prismatica.operators.lineage import cut

NODE = ["view", "name"]


def dependencies(fields: DataFrame) -> DataFrame:
    """view, name, needs: fields of the same view that a field's SQL refers to, itself apart; once each."""
    known = fields.select("view", F.col("name").alias("needs")).distinct()
    named = fields.select(*NODE, F.explode(F.transform(references(F.coalesce("sql", F.lit(""))), lambda r: F.substring_index(r, ".", 1))).alias("needs")).where("needs <> name").distinct()
    return named.join(known, ["view", "needs"], "left_semi").select(*NODE, "needs")


def _trimmed(edges: DataFrame) -> DataFrame:
    """Edges on cycles and between them: those whose end needs nothing, or whose start nobody needs, are peeled off round by round."""
    size = -1
    while (now := edges.count()) not in (size, 0):
        size = now
        edges = edges.join(edges.select("view", F.col("name").alias("needs")).distinct(), ["view", "needs"], "left_semi")
        edges = cut(edges.join(edges.select("view", F.col("needs").alias("name")).distinct(), NODE, "left_semi").select(*NODE, "needs"))
    return edges


def _spread(edges: DataFrame, labels: DataFrame, of: str, to: str) -> DataFrame:
    """Labels (view, name, label), lowered along the edges from ``of`` to ``to`` until nothing changes."""
    changed = labels
    while changed.take(1):
        sent = edges.join(changed.select("view", F.col("name").alias(of), "label"), ["view", of]).groupBy("view", F.col(to).alias("name")).agg(F.min("label").alias("label"))
        both = labels.withColumn("old", F.col("label")).unionByName(sent, allowMissingColumns=True).groupBy(NODE).agg(F.min("label").alias("label"), F.min("old").alias("old"))
        both = cut(both)
        changed = both.where("old is null or label < old").select(*NODE, "label")
        labels = both.select(*NODE, "label")
    return labels


def broken_edges(edges: DataFrame, places: DataFrame) -> DataFrame:
    """view, name, needs: the dependencies that are left out so that none is on a cycle.

    On the cycles that hang together, those that need their first field (by ``places``: view, name, position) are left out; what is
    still on a cycle then is treated alike.  A ring loses one edge, as if fields were visited in their order.
    """
    gone = edges.limit(0)
    left = _trimmed(cut(edges))
    while left.take(1):
        nodes = left.select(*NODE).distinct().join(places.select(*NODE, F.col("position").alias("label")), NODE)
        # The first field that each one leads to; a field that leads to none before itself is the first of its cycles.
        first = _spread(left, nodes, "needs", "name")
        heads = first.join(nodes.withColumnRenamed("label", "own"), NODE).where("label = own").select(*NODE, "label")
        reached = _spread(left, heads, "name", "needs").withColumnRenamed("label", "head")
        inside = first.join(reached, NODE).where("label = head").select(*NODE, "head")
        bad = left.join(heads.select("view", F.col("name").alias("needs"), "label"), ["view", "needs"]).join(inside, NODE).where("head = label").select(*NODE, "needs")
        bad = cut(bad)
        gone = gone.unionByName(bad)
        left = _trimmed(cut(left.join(bad, [*NODE, "needs"], "left_anti")))
    return gone


def levels(fields: DataFrame) -> DataFrame:
    """view, name, position, level, left_out (needs that are left out as they would close a cycle): one row for each field.

    ``fields`` are (view, name, position, sql), with names that are distinct within a view.  A field without needs has level 0, any
    other one more than the highest of its needs.  As many rounds as there are levels, each over all views at once.
    """
    places = cut(fields.select(*NODE, "position"))
    edges = cut(dependencies(fields))
    gone = cut(broken_edges(edges, places))
    edges = edges.join(gone, [*NODE, "needs"], "left_anti")
    left, done, level = places.select(*NODE), None, 0
    while True:
        edges = cut(edges)
        ready = left.join(edges.select(*NODE).distinct(), NODE, "left_anti").withColumn("level", F.lit(level))
        done = ready if done is None else done.unionByName(ready)
        if not edges.take(1):
            break
        done = cut(done)
        left = left.join(done, NODE, "left_anti")
        edges = edges.join(done.select("view", F.col("name").alias("needs")), ["view", "needs"], "left_anti").select(*NODE, "needs")
        level += 1
    out = gone.groupBy(NODE).agg(F.array_sort(F.collect_set("needs")).alias("left_out"))
    return places.join(done, NODE).join(out, NODE, "left").select(*NODE, "position", "level", F.coalesce("left_out", F.array().cast("array<string>")).alias("left_out"))


# ---------------------------------------------------------------------------------------------- batches


def _step(state: Column, starts: Column, size: int) -> Column:
    """State after one more field: how many the batch has (``size`` stands for that many and more), and how many were opened."""
    opens = (state["held"] >= size) & starts
    return F.struct(F.when(opens, 1).otherwise(F.least(state["held"] + 1, F.lit(size))).alias("held"), (state["opened"] + opens.cast("int")).alias("opened"))


def _state(held, opened) -> Column:
    return F.struct(F.lit(held).cast("int").alias("held") if isinstance(held, int) else held.cast("int").alias("held"), F.lit(opened).cast("int").alias("opened") if isinstance(opened, int) else opened.cast("int").alias("opened"))


def _then(state: Column, part: Column) -> Column:
    """State after a part whose effect is known for every state before it."""
    after = F.get(part, state["held"])
    return _state(after["held"], state["opened"] + after["opened"])


def _before(parts: DataFrame, size: int, width: int) -> DataFrame:
    """view, n, entry: the state before each part (view, n, effect).

    Effects of ``width`` parts in a row compose to one, those again, until one group is left in each view; on the way back every part
    gets the state before it.  No group holds more than ``width`` parts.
    """
    parts = parts.withColumn("up", F.expr(f"n div {width}"))
    groups = parts.groupBy("view", "up").agg(F.array_sort(F.collect_list(F.struct("n", "effect"))).alias("all"))
    if (parts.agg(F.max("up")).first()[0] or 0) == 0:
        entered = groups.withColumn("entry", _state(0, 0))
    else:
        whole = F.transform(F.sequence(F.lit(0), F.lit(size)), lambda s: F.aggregate("all", _state(s, 0), lambda a, x: _then(a, x["effect"])))
        above = _before(groups.select("view", F.col("up").alias("n"), whole.alias("effect")), size, width)
        entered = groups.join(above.withColumnRenamed("n", "up"), ["view", "up"])
    place = F.posexplode("all").alias("k", "part")
    rows = entered.select("view", "entry", "all", place)
    entry = F.aggregate(F.slice("all", F.lit(1), F.col("k")), F.col("entry"), lambda a, x: _then(a, x["effect"]))
    return rows.select("view", F.col("part.n").alias("n"), entry.alias("entry"))


def batches(ordered: DataFrame, size: int = 30, whole: int = 150, width: int = 64) -> DataFrame:
    """view, name, at, batch (from 1) of ``ordered`` (view, name, at: places from 1 without gaps).

    A view of at most ``whole`` fields is one batch.  In larger ones a batch that has ``size`` fields ends where the first word of the
    names (up to an underscore) changes, so fields with a common first word stay together even if the batch grows.  Each stretch of
    ``width`` fields becomes the effect that it has on any batch before it; effects compose, so no task needs a whole view.
    """
    counts = ordered.groupBy("view").agg(F.count("*").alias("n_fields"))
    rows = ordered.select("view", "name", F.col("at").cast("long").alias("at")).join(counts, "view")
    small = rows.where(F.col("n_fields") <= whole).select("view", "name", "at", F.lit(1).alias("batch"))
    large = rows.where(F.col("n_fields") > whole).withColumn("word", F.substring_index("name", "_", 1))
    # The last field of a stretch is also shown to the next one.
    stretch = F.expr(f"(at - 1) div {width}")
    spots = F.when(F.col("at") % width == 0, F.array(F.struct(stretch.alias("n"), F.lit(True).alias("own")), F.struct((stretch + 1).alias("n"), F.lit(False).alias("own")))).otherwise(F.array(F.struct(stretch.alias("n"), F.lit(True).alias("own"))))
    shown = large.select("view", "name", "at", "word", F.explode(spots).alias("s")).select("view", "name", "at", "word", "s.*")
    parts = shown.groupBy("view", "n").agg(F.array_sort(F.collect_list(F.struct("at", "word", "name", "own"))).alias("all")).where(F.exists("all", lambda x: x["own"]))
    started = F.transform("all", lambda x, i: F.struct(x["at"], x["name"], x["own"], F.coalesce(x["word"] != F.get("all", i - 1)["word"], F.lit(True)).alias("starts")))
    parts = cut(parts.select("view", "n", F.filter(started, lambda x: x["own"]).alias("all")))
    effect = F.transform(F.sequence(F.lit(0), F.lit(size)), lambda s: F.aggregate("all", _state(s, 0), lambda a, x: _step(a, x["starts"], size)))
    entries = _before(cut(parts.select("view", "n", effect.alias("effect"))), size, width)
    found = parts.join(entries, ["view", "n"]).select("view", "entry", "all", F.posexplode("all").alias("k", "field"))
    state = F.aggregate(F.slice("all", F.lit(1), F.col("k") + 1), F.col("entry"), lambda a, x: _step(a, x["starts"], size))
    return small.unionByName(found.select("view", "field.name", "field.at", (state["opened"] + 1).alias("batch")))


def field_batches(fields: DataFrame, size: int = 30, whole: int = 150) -> DataFrame:
    """view, name, at, batch of ``fields`` (view, name, position, sql): by level, then position, in batches."""
    order = Window.partitionBy("view").orderBy("level", "position", "name")
    return batches(levels(fields).select(*NODE, F.row_number().over(order).alias("at")), size, whole)
