"""Concepts and what is said unlike in them, against plain loops."""

import random

import pytest

from prismatica.operators import vocabulary

FIELDS = "view string, kind string, name string, type string, sql string, label string, description string, tags array<string>"


@pytest.fixture(scope="module")
def made():
    pick = random.Random(3)
    rows = []
    for i in range(300):
        sql = pick.choice([f"${{TABLE}}.c{pick.randrange(120)}", f"${{c{pick.randrange(120)}}}", f"${{v1.C{pick.randrange(120)}}}", "${TABLE}.id", "${TABLE}.c1 + 1", None])
        rows.append((f"v{pick.randrange(6)}", pick.choice(["dimension", "measure"]), f"c{pick.randrange(120)}", "sum", sql, None, None, None))
    return rows


def test_concepts_equal_a_union_of_sets(spark, made):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def node(kind, name):
        return ("measure sum:" if kind == "measure" else "dimension:") + name.lower()

    for _, kind, name, _, sql, *_ in made:
        a = root(node(kind, name))
        if sql and "+" not in sql and sql != "${TABLE}.id":
            b = root(node(kind, sql.replace("${TABLE}.", "").strip("${}").split(".")[-1]))
            parent[max(a, b)] = min(a, b)
    got = {(r["kind"], r["name"], r["concept"]) for r in vocabulary.concepts(spark.createDataFrame(made, FIELDS)).collect()}
    assert got == {(kind, name, root(node(kind, name))) for _, kind, name, *_ in made}


def test_long_chains_and_empty_tables(spark):
    chain = [("v", "dimension", f"f{n:03}", "string", f"${{f{n + 1:03}}}", None, None, None) for n in range(200)]
    assert {r["concept"] for r in vocabulary.concepts(spark.createDataFrame(chain, FIELDS)).collect()} == {"dimension:f000"}
    none = vocabulary.issues(spark.createDataFrame([], FIELDS), spark.createDataFrame([], "term string, canonical string"))
    assert none.count() == 0 and tuple(vocabulary.report(none).first()) == (True, 0, 0, 0)


def test_repeats_nulls_and_extra_columns(spark):
    one = ("a", "dimension", "x", None, None, "Net", "Before taxes", ["t", None, "t"])
    rows = [one, one, ("b", "dimension", "X", None, None, "NET!", "After all taxes", None), ("c", "dimension", "y", None, None, "Else", None, None), (None, "dimension", "x", None, None, "q", None, None), ("d", None, None, None, None, None, None, None)]
    fields = spark.createDataFrame([(*r, "no", "no") for r in rows], FIELDS + ", concept string, phrase string")
    got = {(r["view"], r["issue"], r["severity"], r["found"], r["expected"]) for r in vocabulary.issues(fields).collect()}
    assert got == {("b", "label", "low", "NET!", "Net"), ("b", "description", "high", "After all taxes", "Before taxes"), ("b", "tag", "medium", None, "t")}
