"""Containment against all pairs, and what the queries over tables don't reach of coverage by it."""

import random

from prismatica.operators import containment, corpus


def test_contained_equals_all_pairs(spark):
    rnd = random.Random(14)
    word = lambda n: "".join(rnd.choice("ab c") for _ in range(n))
    needles = [(g, word(rnd.randint(0, 7))) for g in "xy" for _ in range(80)] + [("x", None), ("x", "a\n' \""), ("z", "a"), ("x", "é"), ("x", "😀b"), ("x", "A")]
    texts = [(g, f"{g}{i}", word(rnd.randint(0, 40))) for g in "xyw" for i in range(60)] + [("x", "null", None), ("x", "odd", "has a\n' \" é 😀b"), ("x", "long", "ab" * 200_000 + "cc")]
    got = containment.contained(spark.createDataFrame(needles, "group string, needle string"), spark.createDataFrame(texts, "group string, source string, text string")).collect()
    want = {(g, n, s) for g, n in needles if n for h, s, t in texts if g == h and t and n in t}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_common_pieces_and_no_rows(spark):
    texts = spark.range(3000).selectExpr("'' as group", "id as source", "concat('the same beginning of ', id % 7) as text")
    needles = spark.createDataFrame([("", "the same"), ("", "of 3"), ("", "of 9")], "group string, needle string")
    got = containment.contained(needles, texts).groupBy("needle").count().collect()
    assert {r["needle"]: r["count"] for r in got} == {"the same": 3000, "of 3": sum(i % 7 == 3 for i in range(3000))}
    assert containment.contained(needles.limit(0), texts).count() == containment.contained(needles, texts.limit(0)).count() == 0


def covered(spark, sql, fields=(), views=(), explores=()):
    prints = corpus.fingerprints(spark.createDataFrame([("q", "", sql)], "query_id string, prompt string, sql string"))
    out = containment.check(
        prints,
        spark.createDataFrame(list(fields), "view string, kind string, name string, type string, sql string"),
        spark.createDataFrame(list(views), "view string, table string, derived string"),
        spark.createDataFrame(list(explores), "explore string, base string, always_where string, joins array<struct<view:string,sql_on:string,relationship:string>>"),
    )
    return {(r["need"], r["column"]): r["covered"] for r in out.collect()}


def test_the_beginning_of_a_case_and_parts_of_names(spark):
    sql = "WITH big AS (SELECT a FROM t WHERE kind = 'x') SELECT CASE WHEN amount > 100 AND kind = 'b' THEN 'one' ELSE 'two' END AS c, SUM(price), region FROM big WHERE state = 1"
    fields = [
        ("t", "dimension", "other", "string", "(CASE  WHEN amount > 100\n AND kind = 'zzz' THEN 'q' END)"),
        ("t", "measure", "total", "sum", "${TABLE}.list_price_usd"),
        ("t", "measure", "most", "max", "${TABLE}.region_code + ${TABLE}.state_code"),
    ]
    views = [("t", "t", None), ("the_big_dt", None, "SELECT a FROM t WHERE subkind = 'not X here'")]
    got = covered(spark, sql, fields, views)
    assert got["case", "c"] and got["measure", "price"] and got["derived", "big"] and got["structural", "kind"]
    assert got["dimension", "region"] and not got["dimension", "state"]  # a filtered column needs a dimension
    fields[0] = ("t", "dimension", "other", "string", "CASE WHEN amount > 101 AND kind = 'zzz' THEN 'q' END")
    views[1] = ("the_bi_dt", None, "SELECT a FROM t WHERE subkind = 'y'")
    got = covered(spark, sql, fields, views)
    assert not any((got["case", "c"], got["derived", "big"], got["structural", "kind"]))
