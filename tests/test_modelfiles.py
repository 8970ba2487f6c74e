"""Model files as rows, their merge, and rows as files again."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from prismatica.operators import merge
from prismatica.sources import modelfiles as M

TEXT = r"""# a comment { with a brace
connection: "wh"
view: orders {
  sql_table_name: dw.orders ;;
  label: "Orders \"all\""
  dimension: id { primary_key: yes type: number sql: ${TABLE}.id ;; type: string }
  dimension: status {
    sql: CASE WHEN x = '}' THEN "a;b" # kept
         ELSE 'c' END ;;
    tags: ["t1", "t, 2"]
    link: { label: "go" icon: { deep: yes more: { still: { deeper: { and: { on: yes } } } } } }
  }
  measure: n { type: count filters: [status: "x,y", id: ">0"] drill_fields: [id, status] }
  set: all { fields: [id] }
}
view: d_dt { derived_table: { sql: SELECT 1; ;; persist_for: "1 hour" } extends: [orders] measure: m { type: sum sql: ${x} ;; } }
explore: orders { join: c { from: d sql_on: ${a.x} = ${c.x} ;; relationship: many_to_one } }
"""


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, text string")


def test_blocks_and_attributes(spark):
    found = M.blocks(frame(spark, ("a/orders.view.lkml", TEXT))).cache()
    tops = [(r["kind"], r["name"]) for r in found.where("size(above) = 0").orderBy("at").collect()]
    assert tops == [(None, None), ("view", "orders"), ("view", "d_dt"), ("explore", "orders")]
    assert [a["key"] for a in found.where("at = -1").first()["attributes"]] == ["connection"]
    fields = {r["name"]: r for r in M.fields(found).collect()}
    assert fields["id"]["type"] == "string" and fields["id"]["rest"] == {"primary_key": "yes"}  # the last of repeated keys counts
    assert fields["status"]["tags"] == ["t1", "t, 2"] and fields["status"]["sql"].endswith("ELSE 'c' END") and "# kept" in fields["status"]["sql"]
    assert fields["n"]["rest"] == {"filters": '[status: "x,y", id: ">0"]', "drill_fields": "[id, status]"}
    views = {r["view"]: r for r in M.views(found).collect()}
    assert views["orders"]["label"] == 'Orders "all"' and views["orders"]["inner"] == ["set: all { fields: [ id ] }"]
    assert views["d_dt"]["derived"] == "SELECT 1;" and views["d_dt"]["derived_rest"] == {"persist_for": '"1 hour"'} and views["d_dt"]["rest"] == {"extends": "[orders]"}
    explore = M.explores(found).first()
    assert explore["base"] == "orders" and [(j["view"], j["relationship"], j["sql_on"]) for j in explore["joins"]] == [("d", "many_to_one", "${a.x} = ${c.x}")]


FAULTS = [
    (TEXT, []),
    (None, ["no block"]),
    ("", ["no block"]),
    ("# view: a { }", ["no block"]),
    ('include: "/views/*"', ["no block"]),
    ("view: a { dimension: x { type: string }", ["a block isn't closed"]),
    ("view: a { } }", ["a block is closed too often"]),
    ("} view: a {", ["a block is closed too often"]),
    ("view: a { dimension: x { sql: foo } }", ["a value doesn't end"]),
    ('view: a { label: "open }', ["a value doesn't end"]),
    ("view: a { label: }", ["a key has no value"]),
    ("view: a { label: type: string }", ["a key has no value"]),
    ("view: a { sql_x: { y: z } }", []),
]


def test_faults(spark):
    got: dict[str, list[str]] = {}
    for r in M.faults(frame(spark, *[(str(i), text) for i, (text, _) in enumerate(FAULTS)])).collect():
        got.setdefault(r["path"], []).append(r["fault"])
    assert [sorted(got.get(str(i), [])) for i in range(len(FAULTS))] == [faults for _, faults in FAULTS]


def plain(rows):
    return sorted(({k: v for k, v in r.asDict().items() if k not in ("at", "position")} for r in rows.collect()), key=str)


def test_round_trip(spark):
    found = M.blocks(frame(spark, ("a/orders.view.lkml", TEXT), ("b.lkml", 'view: { dimension: x { label: "" } }'))).cache()
    views, fields = M.views(found), M.fields(found)
    made = M.texts(views, fields).cache()
    assert M.faults(made).count() == 0
    again = M.blocks(made).cache()
    assert plain(M.views(again)) == plain(views) and plain(M.fields(again)) == plain(fields)
    assert [r["text"] for r in M.texts(M.views(again), M.fields(again)).orderBy("path").collect()] == [r["text"] for r in made.orderBy("path").collect()]


def test_very_long_files_and_none(spark):
    many = "view: v {\n" + "".join(f"  dimension: d{i} {{ type: string sql: {'x;' * 40} ;; }}\n" for i in range(4000)) + "}\n"
    long = 'view: w { dimension: x { description: "' + "words and \\\" quotes " * 20_000 + '" sql: ' + "a ; b " * 30_000 + ";; } }"
    files = frame(spark, ("many", many), ("long", long))
    assert M.faults(files).count() == 0
    fields = M.fields(M.blocks(files))
    assert fields.groupBy("path").count().orderBy("path").collect() == [("long", 1), ("many", 4000)]
    none = M.blocks(frame(spark))
    assert M.fields(none).count() == M.views(none).count() == M.explores(none).count() == M.faults(frame(spark)).count() == 0


def test_files_are_read_by_path(spark, tmp_path):
    (tmp_path / "models" / "deep").mkdir(parents=True)
    (tmp_path / "models" / "deep" / "a b.view.lkml").write_text("view: a { }")
    (tmp_path / "models" / "c.lkml").write_text("view: c { }")
    (tmp_path / "models" / "c.sql").write_text("select 1")
    assert sorted(map(tuple, M.model_files(spark, str(tmp_path / "models")).collect())) == [("c.lkml", "view: c { }"), ("deep/a b.view.lkml", "view: a { }")]


def test_publishing_replaces_whole_files(spark, tmp_path):
    folder = str(tmp_path / "out")
    first = frame(spark, ("a/x.lkml", "one\n"), ("b.lkml", "two"), ("c=d.lkml", "three\n\n"))
    assert {r["path"]: r["action"] for r in M.publish_texts(first, folder).collect()} == {"a/x.lkml": "added", "b.lkml": "added", "c=d.lkml": "added"}
    assert sorted(map(tuple, M.published(spark, folder).collect())) == sorted(map(tuple, first.collect()))
    second = frame(spark, ("a/x.lkml", "one\n"), ("b.lkml", "other"))
    assert {r["path"]: r["action"] for r in M.publish_texts(second, folder).collect()} == {"a/x.lkml": "kept", "b.lkml": "replaced"}
    assert dict(map(tuple, M.published(spark, folder).collect())) == {"a/x.lkml": "one\n", "b.lkml": "other", "c=d.lkml": "three\n\n"}
    M.publish_texts(second, folder)  # a repeated run changes nothing
    ledger = spark.read.parquet(f"{folder}/ledger")
    assert sorted((r["path"], r["action"]) for r in ledger.collect()) == [("a/x.lkml", "added"), ("b.lkml", "added"), ("b.lkml", "replaced"), ("c=d.lkml", "added")]
    failing = second.withColumn("text", F.when(F.col("path") == "b.lkml", F.raise_error(F.lit("no"))).otherwise(F.lit("never")))
    with pytest.raises(PySparkException):
        M.publish_texts(failing, folder)
    assert dict(map(tuple, M.published(spark, folder).collect())) == {"a/x.lkml": "one\n", "b.lkml": "other", "c=d.lkml": "three\n\n"}


def side(spark, *files):
    rows = frame(spark, *files)
    found = M.blocks(rows).cache()
    return merge.Side(M.views(found), M.fields(found), M.faults(rows))


def test_merge_keeps_order_and_decisions(spark):
    base = side(
        spark,
        ("p", 'view: b { dimension: z { type: string description: "Z" tags: ["2", "1"] } dimension: a { type: number sql: x ;; group_label: "G" description: "A description of thirty characters and more" } measure: z { type: sum } } view: a { label: "A" }'),
        ("broken", "view: x {"),
        ("gone", "view: x {"),
        ("only", "view: o { dimension: k { } parameter: q { } }"),
    )
    new = side(
        spark,
        ("p", 'view: c { filter: f { } } view: b { label: "B" sql_table_name: t ;; measure: new { type: count } parameter: no { } dimension: a { type: string sql: y ;; label: "L" group_label: "H" value_format: "0" hidden: yes description: "other" } dimension: q { } dimension: z { description: "Longer than Z" tags: ["1", "3"] sql: late ;; } }'),
        ("broken", "view: y { dimension: k { } }"),
        ("gone", "view: y { dimension: k { }"),
        ("only", "view: o { dimension: k { }"),
    )
    views, fields, report = (x.cache() for x in merge.merge(base, new))
    assert [tuple(r)[:4] for r in views.where("path = 'p'").orderBy("number").collect()] == [("p", 1, "b", "t"), ("p", 2, "a", None), ("p", 3, "c", None)]
    assert [r["label"] for r in views.where("path = 'p'").orderBy("number").collect()] == ["B", "A", None]
    rows = fields.where("path = 'p' and view = 'b'").orderBy("position").collect()
    assert [(r["kind"], r["name"]) for r in rows] == [("dimension", "z"), ("dimension", "a"), ("measure", "z"), ("measure", "new"), ("dimension", "q")]
    z, a = rows[0], rows[1]
    assert (z["description"], z["tags"], z["sql"]) == ("Longer than Z", ["2", "1", "3"], None)
    assert (a["type"], a["sql"], a["label"], a["rest"]) == ("number", "x", "L", {"group_label": '"G"', "value_format": '"0"'}) and a["description"].startswith("A description")
    assert [r["name"] for r in fields.where("path = 'p' and view = 'c'").collect()] == ["f"]
    assert sorted(map(tuple, report.collect())) == [("broken", "baseline", "enriched"), ("gone", "both", "none"), ("only", "enriched", "baseline")]
    assert [r["view"] for r in fields.where("path = 'broken'").collect()] == ["y"] and sorted(r["name"] for r in fields.where("path = 'only'").collect()) == ["k", "q"]
    assert [tuple(r)[3:] for r in merge.ledger(base.fields, new.fields).collect()] == [("z", "Z", "Longer than Z")]


def test_the_last_of_repeated_names_counts_at_the_first_place(spark):
    twice = side(spark, ("p", "view: a { dimension: x { sql: 1 ;; } dimension: y { } dimension: x { sql: 2 ;; } }"))
    none = side(spark)
    rows = merge.merge_fields(twice.fields, none.fields).orderBy("position").collect()
    assert [(r["position"], r["name"], r["sql"]) for r in rows] == [(1, "x", "2"), (2, "y", None)]
