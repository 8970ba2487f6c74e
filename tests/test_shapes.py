"""Shapes of JSON texts."""

from prismatica.operators import shapes


def test_shapes(spark):
    texts = ['{"a": 1}', '{"a": null, "a.b": [true]}', None, "", "[", "[]", "null", "[[1, 2.5], {}]", '"x"', '{"é 😀": {"": "y"}}']
    got = {r["path"]: tuple(r)[1:] for r in shapes.shapes(spark.createDataFrame([(t,) for t in texts], "j string"), "j").collect()}
    assert got["$"] == (10, "array,invalid,missing,null,object,string", 0, 2, "array,object|empty", True)
    assert got["$.a"] == (2, "int,null", None, None, "", False) and got["$.a.b"] == (1, "array", 1, 1, "bool", False)
    assert got["$[]"] == (2, "array,object", 0, 2, "float,int", True) and got["$[][]"] == (2, "float,int", None, None, "", True)
    assert got["$.é 😀."] == (1, "string", None, None, "", False)
    assert shapes.shapes(spark.createDataFrame([], "j string"), "j").count() == 0


def test_depth_and_long_texts(spark):
    deep = spark.createDataFrame([('{"a":' * 40 + "1" + "}" * 40,), ("[" + ",".join(map(str, range(50_000))) + "]",)], "j string")
    got = {r["path"]: r["n"] for r in shapes.shapes(deep, "j").collect()}
    assert got["$[]"] == 50_000 and max(p.count(".") for p in got) == shapes.DEPTH
    assert {r["path"] for r in shapes.shapes(deep, "j", depth=1).collect()} == {"$", "$.a", "$[]"}


def test_table_summary(spark):
    from prismatica.operators.profile import table_summary

    rows = [(i, f" v{i % 15} " if i % 2 else "", None, "long " * 30 if i == 4 else None) for i in range(60)]
    table = spark.createDataFrame(rows, "n int, `a.b` string, none string, long string").repartition(5, "n")
    got = {r["column"]: r for r in table_summary(table, "n").collect()}
    assert list(got) and set(got) == {"a.b", "none", "long"}
    seen = list(dict.fromkeys(f"v{i % 15}" for i in range(60) if i % 2))
    assert got["a.b"]["first_values"] == seen[:12] and (got["a.b"]["non_empty"], got["a.b"]["distinct_count"], got["a.b"]["position"]) == (30, 15, 2)
    assert (got["none"]["non_empty"], got["none"]["first_values"], got["none"]["avg_length"]) == (0, [], None)
    assert got["long"]["first_values"] == [("long " * 30)[:79] + "…"] and got["long"]["max_length"] == 149
    assert table_summary(table.limit(0), "n").count() == 3
