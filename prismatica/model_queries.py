"""Registered queries over model files that grow with the tables: one file for each customer, from a template with the customer's values.

The oracle SQL builds the expected rows from what the template says and the customer table; it never reads a file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from prismatica.operators import field_order, merge, profile, shapes
from prismatica.registry import query
from prismatica.samples import values
from prismatica.sources import modelfiles

#: {N}: the customer's number, {S}: the segment, {B}: the balance.  The tenth of each ten is broken in the way that {X} says.
FILE = """# view: not_this_one { made for {S}
view: c{N} {
  sql_table_name: dw.{S} ;;
  dimension: id { primary_key: yes type: number sql: ${TABLE}.id ;; }
  dimension: band {
    type: string
    label: "Band \\"{S}\\""
    description: "Band of {S}"
    tags: ["{S}", "a, b"]
    sql: CASE WHEN ${TABLE}.balance >= {B} THEN 'top }' -- "quoted
         ELSE 'rest' END ;;
    link: { label: "go" url: "http://x/{{ value }}" }
  }
  dimension_group: made { type: time timeframes: [raw, date] sql: ${TABLE}.made ;; }
  measure: total { type: sum sql: ${id}; ;; filters: [band: "{S}"] value_format: "0.00" }{X}
}
view: d{N}_dt { derived_table: { sql: SELECT id FROM {S} WHERE balance >= {B} ;; persist_for: "1 hour" } measure: n { type: count } }
explore: c{N} { sql_always_where: ${c{N}.id} > 0 ;; join: d{N}_dt { relationship: one_to_one sql_on: ${c{N}.id} = ${d{N}_dt.id} ;; } join: other { from: nation } }
"""
BROKEN = ("", "", "", "", "", "", " }", " {", ' html: x', ' label: "open')
PATH = "LOWER(c_mktsegment) || '/c' || c_custkey || '.view.lkml'"
_B = "CAST(CAST(FLOOR(ABS(c_acctbal)) AS BIGINT) AS VARCHAR)"
_WHOLE = "c_custkey % 10 < 6"
#: Fixed values of the template by place: view, kind, name, type, sql, label, description, tags (joined by |), other attributes, inner blocks.
FIELDS = [
    (1, "c{N}", "dimension", "id", "number", "${TABLE}.id", None, None, "", "primary_key=yes", ""),
    (2, "c{N}", "dimension", "band", "string", "CASE WHEN ${TABLE}.balance >= {B} THEN 'top }' -- \"quoted\n         ELSE 'rest' END", 'Band "{S}"', "Band of {S}", "{S}|a, b", "", 'link: { label: "go" url: "http://x/{{ value }}" }'),
    (3, "c{N}", "dimension_group", "made", "time", "${TABLE}.made", None, None, "", "timeframes=[raw, date]", ""),
    (4, "c{N}", "measure", "total", "sum", "${id};", None, None, "", 'filters=[band: "{S}"]|value_format="0.00"', ""),
    (5, "d{N}_dt", "measure", "n", "count", None, None, None, "", "", ""),
]
FIELD_COLUMNS = ("place", "view", "kind", "name", "type", "sql", "label", "description", "tags", "rest", "blocks")


def files_of_customers(spark: SparkSession, sf: str) -> DataFrame:
    """path, text: one model file for each customer."""
    # A few bytes of a row become a file that takes a worker a millisecond: rows are spread before that, not left in the table's few splits.
    made = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", "c_mktsegment", "c_acctbal").repartition("c_custkey")
    text = F.lit(FILE)
    amount = F.floor(F.abs("c_acctbal")).cast("bigint").cast("string")
    broken = F.element_at(F.array(*map(F.lit, BROKEN)), (F.col("c_custkey") % 10 + 1).cast("int"))
    for mark, value in (("{N}", F.col("c_custkey").cast("string")), ("{S}", F.col("c_mktsegment")), ("{B}", amount), ("{X}", broken)):
        text = F.replace(text, F.lit(mark), value)
    return made.select(F.concat(F.lower("c_mktsegment"), F.lit("/c"), "c_custkey", F.lit(".view.lkml")).alias("path"), text.alias("text"), "c_custkey")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of the files that can be read whole."""
    return modelfiles.blocks(files_of_customers(spark, sf).where("c_custkey % 10 < 6").select("path", "text"))


def _facts(rows: list[tuple], columns: tuple[str, ...], where: str = _WHOLE) -> str:
    """SQL of what the template says for every customer."""
    marks = lambda c: f"REPLACE(REPLACE(REPLACE({c}, '{{N}}', CAST(c_custkey AS VARCHAR)), '{{S}}', c_mktsegment), '{{B}}', {_B}) AS {c}"
    filled = [marks(c) if any("{" in str(r[i]) for r in rows) else c for i, c in enumerate(columns)]
    return f"SELECT {PATH} AS path, c_custkey, {', '.join(filled)} FROM customer JOIN {values(rows, columns)} ON {where}"


def _flat(rows: DataFrame, *more: str) -> DataFrame:
    """Fields with texts in place of arrays and maps, and ``more`` columns as they are."""
    entries = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return rows.select("path", "view", "kind", "name", "type", "sql", "label", "description", F.array_join("tags", "|").alias("tags"), entries(F.col("rest")).alias("rest"), F.array_join("inner", "|").alias("blocks"), *more)


@query(f"SELECT path, view, kind, name, type, sql, label, description, tags, rest, blocks FROM ({_facts(FIELDS, FIELD_COLUMNS)})")
def model_file_fields(spark, sf):
    return _flat(modelfiles.fields(_blocks(spark, sf)))


@query(
    f"SELECT path, number, view, tbl AS \"table\", derived, rest FROM ({_facts([(1, 'c{N}', 'dw.{S}', None, ''), (2, 'd{N}_dt', None, 'SELECT id FROM {S} WHERE balance >= {B}', 'persist_for=' + chr(34) + '1 hour' + chr(34))], ('number', 'view', 'tbl', 'derived', 'rest'))})"
)
def model_file_views(spark, sf):
    rows = modelfiles.views(_blocks(spark, sf))
    rest = F.array_join(F.transform(F.map_entries("derived_rest"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")
    return rows.select("path", "number", "view", "table", "derived", rest.alias("rest"))


@query(
    f"SELECT path, explore, explore AS base, always_where, place, view, relationship, sql_on FROM ({_facts([(1, 'c{N}', '${c{N}.id} > 0', 'd{N}_dt', 'one_to_one', '${c{N}.id} = ${d{N}_dt.id}'), (2, 'c{N}', '${c{N}.id} > 0', 'nation', None, None)], ('place', 'explore', 'always_where', 'view', 'relationship', 'sql_on'))})"
)
def model_file_explores(spark, sf):
    rows = modelfiles.explores(_blocks(spark, sf)).select("path", "explore", "base", "always_where", F.posexplode("joins").alias("n", "j"))
    return rows.select("path", "explore", "base", "always_where", (F.col("n") + 1).alias("place"), "j.view", "j.relationship", "j.sql_on")


@query(f"SELECT {PATH} AS path, fault FROM customer JOIN (VALUES (6, 'a block is closed too often'), (7, 'a block isn''t closed'), (8, 'a block is closed too often'), (9, 'a value doesn''t end'), (9, 'a block is closed too often')) t(k, fault) ON c_custkey % 10 = k")
def model_file_faults(spark, sf):
    return modelfiles.faults(files_of_customers(spark, sf).select("path", "text"))


# --- merge: what people wrote in the files, and what was proposed for them ---------------------------------------------------------

#: Proposed fields by place: the view and columns of ``FIELDS``; for even customers only.
PROPOSED = [
    (1, "c{N}", "measure", "rows", "count", None, "Rows", "Number of rows of {S}", "n", "", ""),
    (2, "c{N}", "dimension", "band", "string", "other", "Other", "How large the balance of a customer is", "b|{S}", 'group_label="Money"|hidden=yes', ""),
    (3, "c{N}", "measure", "total", "max", "other", "Total", "", "", 'value_format="0"|drill_fields=[id]', ""),
    (4, "c{N}", "filter", "late", "string", None, "Late", "A filter that no one asked for", "", "", ""),
    (5, "e{N}", "dimension", "region", "string", "${TABLE}.region", "Region", "Region of {S}", "", "", ""),
]
_MERGED = [
    (1, *FIELDS[0][1:]),
    (2, *FIELDS[1][1:7], "How large the balance of a customer is", "{S}|a, b|b", 'group_label="Money"', FIELDS[1][10]),
    (3, *FIELDS[2][1:]),
    (4, *FIELDS[3][1:6], "Total", None, "", 'drill_fields=[id]|filters=[band: "{S}"]|value_format="0.00"', ""),
    (5, *PROPOSED[0][1:]),
    (1, *FIELDS[4][1:]),
    (1, *PROPOSED[4][1:]),
]


def _proposed(spark: SparkSession, sf: str) -> merge.Side:
    """Proposals for every even customer's file, and for those that can't be read."""
    rows = files_of_customers(spark, sf).where("c_custkey % 2 = 0").select("path", "c_custkey", F.regexp_extract("text", r"sql_table_name: dw\.(.*?) ;;", 1).alias("segment"))
    said = spark.createDataFrame(PROPOSED, "position int, view string, kind string, name string, type string, sql string, label string, description string, tags string, rest string, inner string")
    fill = lambda c: F.replace(F.replace(c, F.lit("{N}"), F.col("c_custkey").cast("string")), F.lit("{S}"), F.col("segment"))
    tags = F.filter(F.split(fill("tags"), r"\|"), lambda x: x != "")
    pairs = F.filter(F.split(fill("rest"), r"\|"), lambda x: x != "")
    rest = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1), F.regexp_extract(p, "=(.*)$", 1))))
    # Each file gets each proposal: the files are exploded over the constant list, nothing is paired with anything else.
    each = rows.withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(len(PROPOSED))))).join(F.broadcast(said), F.col("p") == F.col("position"))
    found = each.select("path", fill("view").alias("view"), "position", "kind", "name", "type", "sql", "label", fill("description").alias("description"), tags.alias("tags"), rest.alias("rest"), F.array().cast("array<string>").alias("inner"))
    none = lambda t: F.lit(None).cast(t)
    empty = F.create_map().cast("map<string,string>")
    views = rows.select("path", F.explode(F.array(F.struct(F.lit(1).alias("number"), F.concat(F.lit("e"), "c_custkey").alias("view")), F.struct(F.lit(2).alias("number"), F.concat(F.lit("c"), "c_custkey").alias("view")))).alias("v"))
    views = views.select("path", "v.number", "v.view", F.lit("proposed").alias("table"), none("string").alias("derived"), F.lit("Shown").alias("label"), none("string").alias("description"), empty.alias("rest"), empty.alias("derived_rest"), F.array().cast("array<string>").alias("inner"))
    return merge.Side(views, found, spark.createDataFrame([], "path string, fault string"))


def _given(spark: SparkSession, sf: str) -> merge.Side:
    files = files_of_customers(spark, sf).select("path", "text")
    found = modelfiles.blocks(files)
    return merge.Side(modelfiles.views(found), modelfiles.fields(found), modelfiles.faults(files))


_EVEN, _ODD = f"{_WHOLE} AND c_custkey % 2 = 0", f"{_WHOLE} AND c_custkey % 2 = 1"
_BAD_EVEN = "c_custkey % 10 IN (6, 8)"


@query(
    f"SELECT path, view, CAST(place AS INT) AS position, kind, name, type, sql, label, description, tags, rest, blocks FROM ({_facts(_MERGED, FIELD_COLUMNS, _EVEN)}) UNION ALL "
    f"SELECT path, view, CAST(place - CASE WHEN place = 5 THEN 4 ELSE 0 END AS INT), kind, name, type, sql, label, description, tags, rest, blocks FROM ({_facts(FIELDS, FIELD_COLUMNS, _ODD)}) UNION ALL "
    f"SELECT path, view, CAST(place - CASE WHEN place = 5 THEN 4 ELSE 0 END AS INT), kind, name, type, sql, label, description, tags, CASE WHEN name = 'total' THEN 'drill_fields=[id]|value_format=\"0\"' ELSE rest END, blocks FROM ({_facts(PROPOSED, FIELD_COLUMNS, _BAD_EVEN)})"
)
def merged_file_fields(spark, sf):
    b, e, _ = merge.readable(_given(spark, sf), _proposed(spark, sf))
    return _flat(merge.merge_fields(b.fields, e.fields), "position")


@query(
    f"SELECT path, CAST(number AS INT) AS number, view, tbl AS \"table\", derived, label FROM ({_facts([(1, 'c{N}', 'dw.{S}', None, 'Shown'), (2, 'd{N}_dt', None, 'SELECT id FROM {S} WHERE balance >= {B}', None), (3, 'e{N}', 'proposed', None, 'Shown')], ('number', 'view', 'tbl', 'derived', 'label'), _EVEN)}) UNION ALL "
    f"SELECT path, number, view, tbl, derived, label FROM ({_facts([(1, 'c{N}', 'dw.{S}', None, None), (2, 'd{N}_dt', None, 'SELECT id FROM {S} WHERE balance >= {B}', None)], ('number', 'view', 'tbl', 'derived', 'label'), _ODD)}) UNION ALL "
    f"SELECT path, number, view, tbl, derived, label FROM ({_facts([(1, 'e{N}', 'proposed', None, 'Shown'), (2, 'c{N}', 'proposed', None, 'Shown')], ('number', 'view', 'tbl', 'derived', 'label'), _BAD_EVEN)})"
)
def merged_file_views(spark, sf):
    b, e, _ = merge.readable(_given(spark, sf), _proposed(spark, sf))
    return merge.merge_views(b.views, e.views).select("path", "number", "view", "table", "derived", "label")


@query(f"SELECT {PATH} AS path, 'c' || c_custkey AS view, 'dimension' AS kind, 'band' AS name, 'Band of ' || c_mktsegment AS was, 'How large the balance of a customer is' AS now FROM customer WHERE {_EVEN}")
def merged_file_ledger(spark, sf):
    b, e, _ = merge.readable(_given(spark, sf), _proposed(spark, sf))
    return merge.ledger(b.fields, e.fields)


@query(f"SELECT {PATH} AS path, 'baseline' AS unreadable, CASE WHEN c_custkey % 2 = 0 THEN 'enriched' ELSE 'none' END AS taken FROM customer WHERE c_custkey % 10 >= 6")
def merged_file_report(spark, sf):
    return merge.readable(_given(spark, sf), _proposed(spark, sf))[2]


_TEXT = (
    "'view: c' || c_custkey || ' {\n  sql_table_name: dw.' || c_mktsegment || ' ;;\n  dimension: id {\n    type: number\n    sql: ${TABLE}.id ;;\n    primary_key: yes\n  }\n  dimension: band {\n    label: \"Band \\\"' || c_mktsegment || '\\\"\"\n"
    "    description: \"Band of ' || c_mktsegment || '\"\n    type: string\n    sql: CASE WHEN ${TABLE}.balance >= ' || " + _B + " || ' THEN ''top }'' -- \"quoted\n         ELSE ''rest'' END ;;\n    tags: [\"' || c_mktsegment || '\", \"a, b\"]\n"
    "    link: { label: \"go\" url: \"http://x/{{ value }}\" }\n  }\n  dimension_group: made {\n    type: time\n    sql: ${TABLE}.made ;;\n    timeframes: [raw, date]\n  }\n  measure: total {\n    type: sum\n    sql: ${id}; ;;\n"
    "    filters: [band: \"' || c_mktsegment || '\"]\n    value_format: \"0.00\"\n  }\n}\n\nview: d' || c_custkey || '_dt {\n  derived_table: {\n    sql: SELECT id FROM ' || c_mktsegment || ' WHERE balance >= ' || " + _B + " || ' ;;\n    persist_for: \"1 hour\"\n  }\n  measure: n {\n    type: count\n  }\n}\n'"
)


@query(f"SELECT {PATH} AS path, SHA256({_TEXT}) AS text_sha256 FROM customer WHERE {_WHOLE}")
def model_file_texts(spark, sf):
    found = _blocks(spark, sf)
    return modelfiles.texts(modelfiles.views(found), modelfiles.fields(found)).select("path", F.sha2("text", 256).alias("text_sha256"))


# --- the order of a view's fields, and their batches --------------------------------------------------------------------------------


@query(
    "SELECT 'v' || c_custkey // 6 AS view, 'f' || c_custkey % 6 AS name, (ARRAY[2, 1, 0, 3, 4, 5])[c_custkey % 6 + 1] AS level, CASE WHEN c_custkey % 6 = 2 THEN 'f0' ELSE '' END AS left_out "
    "FROM customer WHERE c_custkey // 6 * 6 + 5 <= (SELECT MAX(c_custkey) FROM customer)"
)
def field_levels(spark, sf):
    """In every six fields three refer to each other in a ring, and three to the one before them."""
    at = F.col("c_custkey") % 6
    needs = F.when(at < 2, at + 1).when(at == 2, 0).when(at == 3, 0).otherwise(at - 1)
    rows = spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", F.max("c_custkey").over(Window.partitionBy(F.expr("c_custkey div 6"))).alias("last")).where("last % 6 = 5")
    sql = F.concat(F.lit("${f"), needs, F.lit("} + ${f"), needs, F.lit(".raw} + ${TABLE}.x + ${f"), at, F.lit("}"))
    made = rows.select(F.concat(F.lit("v"), F.expr("c_custkey div 6")).alias("view"), F.concat(F.lit("f"), at).alias("name"), at.alias("position"), sql.alias("sql"))
    return field_order.levels(made).select("view", "name", "level", F.array_join("left_out", ",").alias("left_out"))


@query(
    "WITH RECURSIVE n AS (SELECT c_custkey % 3 AS v, c_custkey // 3 + 1 AS pos, 'w' || (c_custkey // 3 * 7 // 50) || CASE WHEN c_custkey // 3 % 5 = 0 THEN '' ELSE '_' || c_custkey END AS name FROM customer), c AS (SELECT v, COUNT(*) AS n FROM n GROUP BY v), "
    "w AS (SELECT n.v, pos, name, STRING_SPLIT(name, '_')[1] AS word, c.n > 150 AS large FROM n JOIN c ON n.v = c.v), "
    "b AS (SELECT v, pos, name, word, large, 1 AS held, 1 AS batch FROM w WHERE pos = 1 UNION ALL SELECT w.v, w.pos, w.name, w.word, w.large, CASE WHEN w.large AND held >= 30 AND w.word <> b.word THEN 1 ELSE held + 1 END, batch + CASE WHEN w.large AND held >= 30 AND w.word <> b.word THEN 1 ELSE 0 END FROM b JOIN w ON w.v = b.v AND w.pos = b.pos + 1) "
    "SELECT 'v' || v AS view, pos AS \"at\", name, batch FROM b"
)
def field_batches(spark, sf):
    rows = spark.read.parquet(f"{sf}/customer.parquet").select(F.expr("c_custkey % 3").alias("v"), F.expr("c_custkey div 3 + 1").alias("at"), "c_custkey")
    name = F.concat(F.lit("w"), F.expr("(c_custkey div 3 * 7) div 50"), F.when(F.expr("c_custkey div 3 % 5 = 0"), F.lit("")).otherwise(F.concat(F.lit("_"), F.col("c_custkey"))))
    return field_order.batches(rows.select(F.concat(F.lit("v"), "v").alias("view"), "at", name.alias("name")))


# --- shapes of JSON texts -------------------------------------------------------------------------------------------------------------


@query("SELECT path, COUNT(*) AS n, ANY_VALUE(kind) AS kinds, ANY_VALUE(size) AS least_size, ANY_VALUE(size) AS most_size, '' AS elements, false AS mixed FROM events JOIN (VALUES ('$', 'object', CAST(1 AS BIGINT)), ('$.k', 'int', NULL)) t(path, kind, size) ON props LIKE '{\"k\": %}' GROUP BY path")
def event_shapes(spark, sf):
    return shapes.shapes(spark.read.parquet(f"{sf}/events.parquet"), "props")


_NESTS = [
    '{"a": [1, "x", {"b": [[{V}], []]}], "o": {"p": null, "q": true}}',
    '{"a": [], "o": {"p": {V}.5, "r": {"s": {"t": {"u": {"v": {"w": 1}}}}}}}',
    '[{V}, 2]',
    '"text"',
    "{not json",
]
#: Fixed values of the texts above: path, kinds, the templates that have it with how often, sizes, kinds of elements, whether mixed.
_NEST_FACTS = [
    ("$", "array,invalid,object,string", "1,1,1,1,1", 2, 2, "int", True),
    ("$.a", "array", "1,1,0,0,0", 0, 3, "empty|int,object,string", True),
    ("$.a[]", "int,object,string", "3,0,0,0,0", 1, 1, "", True),
    ("$.a[].b", "array", "1,0,0,0,0", 2, 2, "array", False),
    ("$.a[].b[]", "array", "2,0,0,0,0", 0, 1, "empty|int", False),
    ("$.a[].b[][]", "int", "1,0,0,0,0", None, None, "", False),
    ("$.o", "object", "1,1,0,0,0", 2, 2, "", False),
    ("$.o.p", "float,null", "1,1,0,0,0", None, None, "", False),
    ("$.o.q", "bool", "1,0,0,0,0", None, None, "", False),
    ("$.o.r", "object", "0,1,0,0,0", 1, 1, "", False),
    ("$.o.r.s", "object", "0,1,0,0,0", 1, 1, "", False),
    ("$.o.r.s.t", "object", "0,1,0,0,0", 1, 1, "", False),
    ("$.o.r.s.t.u", "object", "0,1,0,0,0", 1, 1, "", False),
    ("$.o.r.s.t.u.v", "object", "0,1,0,0,0", 1, 1, "", False),
    ("$[]", "int", "0,0,2,0,0", None, None, "", False),
]


@query(
    f"SELECT path, CAST(SUM(CAST(STRING_SPLIT(times, ',')[event_id % 5 + 1] AS INT)) AS BIGINT) AS n, kinds, CAST(a AS BIGINT) AS least_size, CAST(z AS BIGINT) AS most_size, elements, mixed FROM events JOIN {values(_NEST_FACTS, ('path', 'kinds', 'times', 'a', 'z', 'elements', 'mixed'))} ON true GROUP BY ALL"
)
def nested_shapes(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id")
    template = F.element_at(F.array(*map(F.lit, _NESTS)), (F.col("event_id") % len(_NESTS) + 1).cast("int"))
    return shapes.shapes(rows.select(F.replace(template, F.lit("{V}"), F.col("user_id").cast("string")).alias("text")), "text")


# --- columns of tables ------------------------------------------------------------------------------------------------------------------

_CELLS = " UNION ALL ".join(f"SELECT {i} AS position, '{c}' AS col, '{t}' AS type, TRIM(CAST({c} AS VARCHAR)) AS v, o_orderkey AS at_row FROM orders" for i, c, t in ((2, "o_custkey", "bigint"), (3, "o_orderstatus", "string"), (6, "o_orderpriority", "string")))


@query(
    f"WITH c AS ({_CELLS}), d AS (SELECT position, col, type, v, MIN(at_row) AS first, COUNT(*) AS n FROM c WHERE v <> '' GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY col ORDER BY first, v) AS k FROM d) "
    "SELECT position, col AS \"column\", type, true AS nullable, CAST(SUM(n) AS BIGINT) AS non_empty, COUNT(*) AS distinct_count, STRING_AGG(v, '|' ORDER BY k) FILTER (WHERE k <= 12) AS first_values, ROUND(SUM(n * LENGTH(v)) / SUM(n), 1) AS avg_length, MAX(LENGTH(v)) AS max_length FROM r GROUP BY position, col, type"
)
def table_summary(spark, sf):
    out = profile.table_summary(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", ["o_custkey", "o_orderstatus", "o_orderpriority"])
    return out.withColumn("first_values", F.array_join("first_values", "|"))
