import json

import pytest
from pyspark.sql import functions as F

from prismatica import samples
from prismatica.functions import naming
from prismatica.operators import corpus, fields, profile
from prismatica.sources import corpus as source
from prismatica.streaming.corpus import field_frequency_so_far, follow_field_frequency, new_queries


@pytest.fixture(scope="module")
def prints(spark):
    return {r["query_id"]: r for r in corpus.fingerprints(spark.createDataFrame(samples.CORPUS, "query_id string, prompt string, sql string")).collect()}


def test_aggregate_and_filter_columns(prints):
    assert [tuple(a)[:3] for a in prints["Q01"]["aggregations"]] == [("SUM", "l_extendedprice", False)]
    assert prints["Q01"]["filter_columns"] == ["l_returnflag", "l_linestatus"]
    assert [tuple(a)[:3] for a in prints["Q07"]["aggregations"]] == [("SUM", "o_totalprice", False), ("COUNT", "o_custkey", True)]
    assert [tuple(d) for d in prints["Q02"]["date_parts"]] == [("o_orderdate", "YEAR")]


def test_ctes_are_no_tables_and_joins_keep_their_order(prints):
    assert prints["Q09"]["ctes"] == ["o", "b"] and sorted(prints["Q09"]["tables"]) == ["customer", "orders"]
    assert [(j["position"], j["table"]) for j in prints["Q10"]["joins"]] == [(1, "supplier"), (2, "nation"), (3, "region")]
    assert prints["Q10"]["primary_table"] == "lineitem" and prints["Q08"]["joins"][0]["kind"] == "left"
    assert prints["Q03"]["dimensions"] == ["c_mktsegment"]


SCRIPTS = [
    ("empty", "  ;; ", [], "empty_input"),
    ("quotes", "''", [], "empty_input"),
    ("ddl", "CREATE TABLE t (a INT)", [], "not_a_query"),
    ("temp", "CREATE OR REPLACE TEMP TABLE x AS SELECT a FROM p.d.base WHERE k = 1; ", ["base"], None),
    ("script", "DECLARE d DATE DEFAULT CURRENT_DATE(); SELECT a FROM base -- where\n", ["base"], None),
    ("fence", "```sql\nSELECT ‘x’ FROM `proj-1`.d.base\n```", ["base"], None),
    ("nothing", None, [], "empty_input"),
]


def test_edge_texts(spark):
    rows = corpus.fingerprints(spark.createDataFrame([(i, i, s) for i, s, _, _ in SCRIPTS], "query_id string, prompt string, sql string")).collect()
    got = {r["query_id"]: r for r in rows}
    for name, _, tables, error in SCRIPTS:
        assert got[name]["parse_error"] == error, name
        if error is None:
            assert got[name]["tables"] == tables, name
    assert got["temp"]["temp_tables"] == ["x"] and got["empty"]["complexity"] == "unknown"


def test_sources(spark, tmp_path):
    for name, sql in (("b.sql", "SELECT 2 FROM t"), ("a.sql", "SELECT 1\nFROM t")):
        (tmp_path / name).write_text(sql)
    assert [tuple(r) for r in source.sql_files(spark, str(tmp_path)).orderBy("query_id").collect()] == [("Q01", "a", "SELECT 1\nFROM t"), ("Q02", "b", "SELECT 2 FROM t")]
    (tmp_path / "s.csv").write_text('Prompt,SQL,id\np,"SELECT 1",n1\n,,\nq,SELECT 2,\n')
    assert [tuple(r)[:3] for r in source.sheet(spark, str(tmp_path / "s.csv"), "prompt", "sql", natural_id="ID").orderBy("query_id").collect()] == [("n1", "p", "SELECT 1"), ("q_0002", "q", "SELECT 2")]
    with pytest.raises(ValueError, match="no column"):
        source.sheet(spark, str(tmp_path / "s.csv"), "question", "sql")
    meta = [{"display_name": "T", "schema": {"schema_attributes": [{"attribute_details": {"attribute_name": "a", "attribute_desc": "x"}, "sensitivity_details": {"is_pii": True}}, {"attribute_details": {"attribute_name": "b"}}]}}]
    (tmp_path / "t.json").write_text(json.dumps(meta))
    columns = source.metadata_cache(spark, str(tmp_path))
    assert {(r["name"], r["is_pii"]) for r in columns.collect()} == {("a", True), ("b", False)}
    wanted = spark.createDataFrame([("t",), ("missing",)], "table string")
    assert {tuple(r) for r in source.metadata_coverage(columns, wanted).collect()} == {("t", 2, 0.5), ("missing", 0, 0.0)}


def test_baselines(spark):
    files = spark.createDataFrame([("sub/orders.view.lkml", ""), ("orders.view.lkml", ""), ("x/bq_part.view.lkml", ""), ("y/odd.view.lkml", "view: customer {")], "path string, head string")
    tables = spark.createDataFrame([("orders",), ("part",), ("customer",), ("none",)], "table string")
    assert {tuple(r) for r in source.resolve_baselines(tables, files).collect()} == {("orders", "orders.view.lkml"), ("part", "x/bq_part.view.lkml"), ("customer", "y/odd.view.lkml")}
    kinds = files.select("path").union(spark.createDataFrame([("a/manifest.lkml",), ("b.model.lkml",), ("c.txt",)], "path string")).select(source.model_file_kind(F.col("path"))).collect()
    assert [r[0] for r in kinds] == ["view"] * 4 + ["manifest", "model", None]


def field_rows(spark, rows):
    return spark.createDataFrame([(*r[:7], r[7].split(",") if r[7] else []) for r in rows], "view string, kind string, name string, type string, sql string, label string, description string, tags array<string>")


def test_merge_is_idempotent_and_keeps_what_must_stay(spark):
    b, e = field_rows(spark, samples.BASELINE), field_rows(spark, samples.ENRICHED)
    once = fields.merge_fields(b, e)
    assert sorted(map(str, once.collect())) == sorted(map(str, fields.merge_fields(once, e).collect()))
    got = {r["name"]: r for r in once.collect()}
    assert got["o_orderkey"]["sql"] == "${TABLE}.o_orderkey" and got["o_orderkey"]["tags"] == ["primary_key", "id"]
    assert got["o_orderstatus"]["description"].startswith("The status") and got["n"]["description"] == "Number of orders placed"
    assert {r["name"] for r in fields.overwrites(b, e).collect()} == {"o_orderkey", "n"}


def test_gates(spark):
    gate = {r["view"]: r for r in fields.enrichment_gate(field_rows(spark, samples.BASELINE)).collect()}
    assert gate["orders"]["status"] == "fail" and "description" in gate["orders"]["blocking"]
    ranked = spark.createDataFrame([("a", 1, ["b"]), ("b", 2, ["a"]), ("c", 2, ["d"]), ("e", 3, [])], "table string, place int, blocked_by array<string>")
    assert {tuple(r) for r in fields.staging_gate(ranked).collect()} == {("b", "repeated place"), ("c", "unknown table"), ("a", "cycle"), ("b", "cycle")}
    share = spark.createDataFrame([("a\nb\nc", "a\nx\nc")], "x string, y string").select(fields.changed_share(F.col("x"), F.col("y"))).first()[0]
    assert round(share, 4) == 0.6667
    assert fields.coverage_share(spark.createDataFrame([], "query_id string, covered boolean")).first()[0] == 100.0
    conflicts = fields.vocabulary_conflicts(field_rows(spark, [*samples.BASELINE, ("x", "dimension", "s", "string", "${TABLE}.o_orderstatus", "State", "other", "")]))
    assert [r["sql"] for r in conflicts.collect()] == ["${TABLE}.o_orderstatus"]


def test_names(spark):
    row = spark.createDataFrame([("cust_xref_id", "FLOAT64", "a|b\nc" * 30)], "n string, t string, x string")
    got = row.select(naming.label(F.col("n")), naming.dimension_type(F.col("t")), naming.measure_name(F.lit("count_distinct"), F.col("n")), F.length(naming.shortened(F.col("x"), 20)), naming.token_estimate(F.lit(2), F.lit(100), F.lit(3), F.array(F.lit(40), F.lit(7)))).first()
    assert tuple(got) == ("Cust Xref Id", "number", "unique_cust_xref_id", 20, 4000 + 50 + 25 + 90 + 11)


def test_profiles(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    assert profile.eligible_columns(orders) == ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    got = {r["column"]: r for r in profile.distinct_values(orders).collect()}
    assert got["o_orderstatus"]["values"] == "F|O|P" and not got["o_orderstatus"]["truncated"]
    assert got["o_orderkey"]["truncated"] and got["o_orderkey"]["values"].count("|") == 49
    assert profile.schema_rows(orders).count() == len(orders.columns)
    sheet = spark.createDataFrame([("SELECT a FROM t", "note"), ("select 1\nfrom x", None), ("", "hi")], "q string, p string")
    assert [tuple(r) for r in corpus.sql_columns(sheet).collect()] == [("q", 1.0)]


def test_views_and_relevant_columns(spark):
    prints = corpus.fingerprints(spark.createDataFrame(samples.CORPUS, "query_id string, prompt string, sql string"))
    mapped = corpus.by_view(prints, spark.createDataFrame([("orders", "order_view")], "table string, view string"))
    assert {r["view"] for r in mapped.collect()} == {"order_view", "lineitem", "customer"}
    cols = {r["table"]: r["columns"] for r in corpus.relevant_columns(prints, 2).collect()}
    assert all(len(c) <= 2 for c in cols.values()) and "orders" in cols
    back = corpus.per_query(corpus.table_context(prints), prints)
    assert back.where("query_id = 'Q10'").first()["tables"] == ["lineitem", "nation", "region", "supplier"]


def test_pattern_signature_does_not_depend_on_table_order(spark):
    import itertools

    rows = [(str(n), "p", f"SELECT 1 FROM {a} JOIN {b} ON x = y JOIN {c} ON y = z") for n, (a, b, c) in enumerate(itertools.permutations(["t1", "t2", "t3"]))]
    found = corpus.signatures(corpus.fingerprints(spark.createDataFrame(rows, "query_id string, prompt string, sql string"))).collect()
    assert {r["signature"].split(" / ")[0] for r in found} == {"t1|t2|t3"} and len(found) == 6


def test_growing_corpus(spark, tmp_path):
    for i, (_, _, sql) in enumerate(samples.CORPUS[:5]):
        (tmp_path / f"q{i}.sql").write_text(sql)
    follow_field_frequency(new_queries(spark, str(tmp_path), 2), str(tmp_path / "counts"), str(tmp_path / "state")).awaitTermination(240)
    batch = corpus.field_frequency(corpus.by_view(corpus.fingerprints(spark.createDataFrame(samples.CORPUS[:5], "query_id string, prompt string, sql string"))))
    assert sorted(map(tuple, field_frequency_so_far(spark, str(tmp_path / "counts")).collect())) == sorted(map(tuple, batch.collect()))


def test_filters_of_functions_and_negations(spark):
    sql = "SELECT a FROM t WHERE LOWER(x) = 'y' AND t.k NOT IN (1, 2) AND z IS NOT NULL AND c = 'a -- b' AND d = 2 GROUP BY a"
    got = corpus.fingerprints(spark.createDataFrame([("q", "p", sql)], "query_id string, prompt string, sql string")).first()
    assert [(p["column"], p["operator"], p["value"], p["negated"]) for p in got["predicates"]] == [("x", "=", "'y'", False), ("k", "IN", "(1, 2)", True), ("z", "IS", "NULL", True), ("c", "=", "'a -- b'", False), ("d", "=", "2", False)]


def test_comma_joins_literals_and_quoted_names(spark):
    sql = "SELECT `my col` FROM a, `p-x.d.b c` z WHERE q = 'from here' AND n = (SELECT MAX(n) FROM d)"
    got = corpus.fingerprints(spark.createDataFrame([("q", "p", sql)], "query_id string, prompt string, sql string")).first()
    assert got["tables"] == ["a", "b c", "d"] and got["main_filters"] == ["q", "n"]


def test_cycles_are_found_by_peeling(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("c", "e"), ("e", "f")]
    assert {r[0] for r in fields.cycles(spark.createDataFrame(edges, "table string, needs string")).collect()} == {"a", "b", "c"}


def test_rows_by_number(spark):
    preview, row_range = source.preview, source.row_range
    rows = spark.createDataFrame([(k, f"v{k}") for k in (30, 10, 20)], "k int, v string")
    assert sorted(tuple(r) for r in row_range(rows, "k", 2, 9).collect()) == [(2, 20, "v20"), (3, 30, "v30")]
    assert [tuple(r) for r in preview(rows, "k", 0).collect()] == [(1, 10, "v10")]
    assert preview(rows.limit(0), "k").count() == 0 and row_range(rows, "k", 4, 5).count() == 0
    for first, last in ((0, 3), (3, 2)):
        with pytest.raises(ValueError):
            row_range(rows, "k", first, last)
    with pytest.raises(ValueError):
        row_range(rows.withColumnRenamed("v", "number"), "k", 1, 2)
