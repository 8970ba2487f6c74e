"""Gates on small fixtures: edges that no template of the registered queries has."""

import pytest

from prismatica.operators import gates

CONTEXT = "table string, ctes array<string>, date_parts array<struct<column:string,function:string>>"
WANTED = "table string, joins array<struct<right_table:string>>"


def found(rows):
    return sorted((r["subject"], r["rule"], r["level"]) for r in rows.collect())


def enriched(spark, files, context=(), wanted=(), questions=()):
    return gates.enrichment(
        spark.createDataFrame(files, "table string, path string, text string"),
        spark.createDataFrame(list(context), CONTEXT),
        spark.createDataFrame(list(wanted), WANTED),
        spark.createDataFrame(list(questions), "table string, query_id string, question string"),
    )


def test_enrichment_of_empty_and_null_files(spark):
    rows = enriched(spark, [("a", "a.view.lkml", ""), ("b", "b.view.lkml", None)])
    assert found(rows) == [("a", "questions", "warn"), ("a", "syntax", "block"), ("b", "questions", "warn"), ("b", "syntax", "block")]
    assert enriched(spark, []).count() == 0


def test_enrichment_takes_the_first_view_and_joins_in_part(spark):
    good = 'description: "fifteen or more characters"'
    text = f'view: a {{ sql_table_name: a ;; dimension: id {{ primary_key: yes {good} sql: ${{TABLE}}.id ;; }} }} view: x {{ dimension: bare {{ }} }} explore: a {{ always_filter: {{ filters: [id: "1"] }} join: q {{ }} join: z {{ }} }}'
    # Only z and q of the wanted joins are there, the other way round; joins of no other table are judged.
    rows = enriched(spark, [("a", "a.view.lkml", text)], wanted=[("a", [("z",), ("y",), ("q",)])], questions=[("a", "Q", "how many"), ("a", "Q", "how many")])
    assert found(rows) == [("a", "join_order", "block")]


@pytest.mark.parametrize(("text", "is_one"), [("1", True), (" [] ", True), ("1] [", False), ("1} {", False), ("1, 2", False), ('1, "b": 2', False), ("", False), (" ", False), (None, False), ("{", False), ('"a', False)])
def test_json(spark, text, is_one):
    row = spark.createDataFrame([(text,)], "t string").select(gates.is_json(gates.F.col("t")).alias("x")).first()
    assert bool(row["x"]) == is_one


def test_publish(spark):
    files = spark.createDataFrame([("a.view.lkml", "view: a { }"), ("b.view.lkml", "view: b { }"), ("c.model.lkml", "explore: c { }"), ("d.view.lkml", None)], "path string, text string")
    baseline = spark.createDataFrame([("a.view.lkml", ""), ("b.view.lkml", "old\nview: b { }"), ("c.model.lkml", "old")], "path string, text string")
    artifacts = spark.createDataFrame([(n, "[]") for n in gates.ARTIFACTS[1:]] + [("x.json", None)], "name string, text string")
    # An empty baseline has no lines that could change, half of the lines of b is not over half, and models aren't compared.
    assert found(gates.pre_publish(files, baseline, artifacts)) == [("d.view.lkml", "syntax", "block"), ("metric_catalog.json", "artifact", "warn"), ("x.json", "json", "block")]


def test_evaluation_without_queries_and_with_lost_ones(spark):
    need = "query_id string, need string, covered boolean"
    empty = spark.createDataFrame([], need)
    assert found(gates.evaluation(empty)) == []
    before = spark.createDataFrame([("gone", True), ("gone", True), ("bad", False)], "query_id string, covered boolean")
    assert found(gates.evaluation(empty, before)) == [("gone", "regression", "block")]
    some = spark.createDataFrame([("q", "join", False), ("q", "join", False), ("r", "measure", True)], need)
    assert found(gates.evaluation(some)) == [("corpus", "coverage", "warn"), ("q", "join_paths", "warn")]


def test_planning_and_operators_with_nulls(spark):
    plans = spark.createDataFrame([("a", None, None, None, None, None, None), ("b", 1, None, 800_000, "x" * 50, 1, 0)], "table string, dimensions int, measures int, tokens bigint, reasoning string, questions int, risks int")
    context = spark.createDataFrame([("b", [], 0), ("c", None, None)], "table string, ctes array<string>, n_cases bigint")
    assert found(gates.planning(plans, context)) == [("a", "fields", "block"), ("a", "questions", "warn"), ("a", "reasoning", "warn"), ("c", "plan", "block")]
    used = spark.createDataFrame([("t", "x", "<>", 1), ("t", "y", "in", 2), ("t", "z", "=", 1)], "table string, column string, operator string, n bigint")
    catalog = spark.createDataFrame([("t", "x", ["!="]), ("t", "x", None), ("t", "y", None)], "table string, column string, operators array<string>")
    assert found(gates.filter_operators(used, catalog)) == [("t.y", "operator", "block"), ("t.z", "catalog", "warn")]


def test_statuses(spark):
    findings = spark.createDataFrame([("a", "warn"), ("a", "block"), ("z", "warn")], "subject string, level string")
    rows = gates.statuses(spark.createDataFrame([("a",), ("b",), ("b",)], "subject string"), findings).collect()
    assert sorted(tuple(r) for r in rows) == [("a", "fail", 1, 1), ("b", "pass", 0, 0), ("z", "warn", 0, 1)]
