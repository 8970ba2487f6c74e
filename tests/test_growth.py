"""What only shows on tables larger than those of the other tests: plans that send a side through the driver, and rules that numbers reach."""

import pytest

import __spark_entry__

QUERIES, ORACLE = __spark_entry__.queries(), __spark_entry__.oracle_sql()


@pytest.mark.parametrize("name", ["merge_ledger", "vocab_cooccurrence"])
def test_no_side_that_grows_is_broadcast(spark, sf, name):
    """The rows are made from the customers' numbers, so their size is estimated far too small."""
    assert "Broadcast" not in QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_plans_of_large_numbers(spark, sf, tmp_path):
    """Numbers over 80,000: only the plans of every fourth customer have too many tokens."""
    duckdb = pytest.importorskip("duckdb")
    rows = spark.read.parquet(f"{sf}/customer.parquet")
    rows.withColumn("c_custkey", rows.c_custkey + 100_000).coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    db = duckdb.connect()
    db.execute(f"create view customer as select * from '{tmp_path}/customer.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["planning_findings"](spark, str(tmp_path)).collect())) == sorted(db.execute(ORACLE["planning_findings"]).fetchall())


def test_statements_are_read_row_by_row(spark):
    """No window, sort or aggregation over the tokens of a corpus: a task's memory doesn't grow with it, and equal ids don't mix."""
    from prismatica.operators.statements import statements

    rows = statements(spark.createDataFrame([(1, "p", "SELECT a FROM t"), (1, "p", "SELECT SUM(b) AS s FROM u; END CASE WHEN"), (None, "p", "SELECT c FROM v WHERE CASE")], "query_id int, prompt string, sql string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not any(step in plan for step in ("Window", "Sort", "Aggregate", "Join"))
    assert sorted(tuple(r.tables) for r in rows.collect()) == [("t",), ("u",), ("v",)]


def test_a_long_statement_is_not_copied_for_each_token(spark):
    """8,000 tokens in one statement take not much longer than in forty."""
    import time

    from pyspark.sql import functions as F

    from prismatica.operators.statements import tokens

    def took(names: int, times: int) -> tuple[float, list]:
        text = "SELECT " + ", ".join(f"c{i}" for i in range(names)) + " FROM t WHERE (x = 1)"
        rows = spark.range(0, times, 1, 1).select(F.concat(F.lit(text), F.when(F.col("id") >= 0, " ")).alias("sql"))
        began = time.perf_counter()
        found = rows.select(tokens(F.col("sql")).alias("t")).collect()
        return time.perf_counter() - began, found[0].t

    took(100, 40)
    (many, _), (one, read) = took(100, 40), took(4000, 1)
    assert len(read) == 8008 and [x.i for x in read] == list(range(1, 8009))
    assert [(x.token, x.clause, x.close) for x in read[-5:-3]] == [("(", "WHERE", 8008), ("x", "WHERE", None)]
    print(f"one {one:.1f} s, forty {many:.1f} s")
    assert one < 7 * many


def test_what_is_bound_is_not_copied(spark):
    """An array of one value, transformed, would copy what becomes of it: all stacks of a fold, for each of its tokens."""
    from pyspark.sql import functions as F

    from prismatica.functions.sqltext import fault
    from prismatica.operators.statements import tokens

    rows = spark.createDataFrame([("SELECT a FROM t",)], "sql string")
    read = rows.select(tokens(F.col("sql")).alias("t"), fault(F.split("sql", " ")).alias("fault"))
    assert "transform(array(" not in read._jdf.queryExecution().optimizedPlan().toString()
    assert [([x.token for x in r.t], r.fault) for r in read.collect()] == [(["SELECT", "a", "FROM", "t"], None)]


def test_faults_read_the_statements_once(spark, sf):
    """Several branches of the plan read the fingerprints, so they are made before it."""
    plan = QUERIES["reconstruction_faults"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "customer" not in plan and "c_custkey" not in plan


def test_needs_are_not_broadcast(spark, sf):
    """Keys of all queries are joined where they lie; only what a model says may go to every task."""
    plan = QUERIES["model_coverage_by_text"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan


def test_origins_join_nothing(spark, sf):
    """What was asked for, described or there before grows with the fields, so it is neither broadcast nor joined."""
    from prismatica.operators import proposals

    assert "Join" not in QUERIES["field_origins"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    rows = lambda *r: spark.createDataFrame(list(r), "view string, name string")
    found = proposals.origins(rows(("v", "a"), ("v", "a"), ("v", "b"), ("v", None), (None, "a"), ("w", "c")), rows(("v", "a"), ("v", "a"), ("x", "a")), rows(("v", "a"), ("v", None), (None, "a"), ("w", "c")), rows(("v", "b"), ("w", "c")))
    assert sorted(map(tuple, found.collect()), key=str) == [("v", "existing_preserved", 2), ("v", "inferred", 1), ("v", "mdm", 1), ("w", "gold_query", 1), (None, "inferred", 1)]


def test_model_files_are_read_row_by_row(spark):
    """No window, sort, join or shuffle over the tokens of files; rows of equal paths, or none, are files of their own."""
    from prismatica.sources import modelfiles as M

    files = spark.createDataFrame([("p", "view: a { dimension: x { tags: [b, c] } }"), ("p", "view: b { measure: y { type: sum }"), (None, "view: c { label: \"C\" }"), ("n", None)], "path string, text string")
    found, faults = M.blocks(files), M.faults(files)
    for rows in (found, faults):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert not any(step in plan for step in ("Window", "Sort", "Aggregate", "Join", "Exchange"))
    assert sorted((str(r.path), r["at"], str(r["kind"]), len(r.attributes)) for r in found.collect()) == [
        ("None", -1, "None", 0), ("None", 2, "view", 1), ("n", -1, "None", 0), ("p", -1, "None", 0), ("p", -1, "None", 0), ("p", 2, "view", 0), ("p", 2, "view", 0), ("p", 5, "dimension", 1), ("p", 5, "measure", 1),
    ]
    assert sorted(map(tuple, faults.collect())) == [("n", "no block"), ("p", "a block isn't closed")]


def test_texts_that_are_not_utf8_are_read(spark):
    from pyspark.sql import functions as F

    from prismatica.sources import modelfiles as M

    files = spark.range(1).select(F.lit("p").alias("path"), F.expr("cast(concat(cast('view: a { label: \"' as binary), x'ff', cast('\" }' as binary)) as string)").alias("text"))
    assert [(r.name, r.attributes[0]["items"]) for r in M.blocks(files).where("kind = 'view'").collect()] == [("a", ['"�"'])] and M.faults(files).count() == 0


def test_merge_reads_each_side_once(spark, sf):
    """The files are read once for their fields and once for their faults, and what can't be read isn't broadcast."""
    plan = QUERIES["merged_file_fields"](spark, sf)._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("MapInArrow") == 2
    # Only the constant list of proposals goes to every task.
    assert plan.count("BroadcastExchange") == 1
