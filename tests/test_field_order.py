"""Levels of dependent fields and their batches against plain Python."""

import random

import pytest

from prismatica.operators import field_order as O


def order(spark, rows):
    frame = spark.createDataFrame([(v, n, p, " + ".join("${%s}" % x for x in needs) or None) for v, n, p, needs in rows], "view string, name string, position int, sql string")
    return {(r["view"], r["name"]): (r["level"], r["left_out"]) for r in O.levels(frame).collect()}


def test_levels_of_rings_chains_and_meeting_cycles(spark):
    rows = [("a", f"c{i}", i, [f"c{i - 1}"] if i else []) for i in range(5)]
    rows += [("a", "self", 9, ["self", "c1.raw", "unknown", "TABLE"])]
    rows += [("ring", x, i, [y]) for i, (x, y) in enumerate([("p", "q"), ("q", "r"), ("r", "p")])]
    # two rings through one field, and a ring that leads into another
    rows += [("two", "m", 0, ["n", "o"]), ("two", "n", 1, ["m"]), ("two", "o", 2, ["m"])]
    rows += [("into", "s", 0, ["t"]), ("into", "t", 1, ["s", "u"]), ("into", "u", 2, ["w"]), ("into", "w", 3, ["u"]), ("into", "end", 4, ["s"])]
    got = order(spark, rows)
    assert {n: got["a", n] for n in ("c0", "c4", "self")} == {"c0": (0, []), "c4": (4, []), "self": (2, [])}
    assert {n: got["ring", n] for n in "pqr"} == {"p": (2, []), "q": (1, []), "r": (0, ["p"])}
    assert {n: got["two", n] for n in "mno"} == {"m": (1, []), "n": (0, ["m"]), "o": (0, ["m"])}
    assert {n: got["into", n] for n in ("s", "t", "u", "w", "end")} == {"w": (0, ["u"]), "u": (1, []), "t": (2, ["s"]), "s": (3, []), "end": (4, [])}


def test_levels_of_any_graph_are_an_order(spark):
    rnd = random.Random(12)
    rows = [(f"v{v}", f"f{i}", i, [f"f{rnd.randrange(9)}" for _ in range(rnd.choice([0, 1, 1, 2]))]) for v in range(12) for i in range(9)]
    got = order(spark, rows)
    assert len(got) == len(rows)
    for v, n, _, needs in rows:
        level, left_out = got[v, n]
        used = {x for x in needs if x != n} - set(left_out)
        assert set(left_out) <= set(needs) and level == max((got[v, x][0] + 1 for x in used), default=0)


def test_levels_of_nothing(spark):
    frame = spark.createDataFrame([], "view string, name string, position int, sql string")
    assert O.levels(frame).count() == O.field_batches(frame).count() == 0


def sequential(names, size, whole):
    out, held, batch, before = [], 0, 1, None
    for name in names:
        word = name.split("_")[0]
        if len(names) > whole and held >= size and word != before:
            batch, held = batch + 1, 0
        held, before = held + 1, word
        out.append(batch)
    return out


@pytest.mark.parametrize(("size", "whole", "width"), [(30, 150, 64), (3, 5, 4), (5, 0, 2)])
def test_batches_equal_the_sequential_rule(spark, size, whole, width):
    rnd = random.Random(13)
    views = {}
    for v, n in enumerate([1, 4, 5, 6, 7, 60, 150, 151, 400]):
        views[f"v{v}"], word = [], 0
        for i in range(n):
            word += rnd.random() < rnd.choice([0.05, 0.5])
            views[f"v{v}"].append(f"w{word}" + f"_{i}" * rnd.randint(0, 2))
    views["hot"] = [f"same_{i}" for i in range(300)]
    rows = [(v, name, i + 1) for v, names in views.items() for i, name in enumerate(names)]
    got = {(r["view"], r["at"]): r["batch"] for r in O.batches(spark.createDataFrame(rows, "view string, name string, at int"), size, whole, width).collect()}
    assert got == {(v, i + 1): b for v, names in views.items() for i, b in enumerate(sequential(names, size, whole))}
