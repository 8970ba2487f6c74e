"""Faults of texts, and the steps that mend them."""

import pytest

from prismatica.operators import repair
from prismatica.operators.statements import statements

WHOLE = [
    "SELECT a FROM t",
    "with x as (select 1) select * from x where a in (select b from c where d) group by a having count(*) > 1 order by a limit 3",
    "(SELECT 1 FROM a) UNION ALL (SELECT 2 FROM b)",
    "SELECT TRIM(BOTH ' ' FROM x), SUM(x) OVER (PARTITION BY a ORDER BY b), t.* EXCEPT (q) FROM t LEFT JOIN u ON t.a IS DISTINCT FROM u.a UNION ALL SELECT 1, 2, 3 FROM u EXCEPT DISTINCT SELECT 1, 2, 3 FROM v",
    "SELECT CASE WHEN CASE WHEN a THEN b END = 1 THEN 2 END FROM t -- SELECT; '",
    "CREATE TEMP TABLE x AS SELECT ';' FROM t",
    "SELECT 'it''s \\' FROM WHERE (' FROM t",
]
BROKEN = {
    "SELECT a FROM t WHERE": "empty_clause",
    "SELECT a FROM t GROUP BY a WHERE b": "clause_order",
    "SELECT a FROM t FROM u": "clause_order",
    "SELECT a FROM t SELECT b FROM u": "clause_order",
    "SELECT (SELECT FROM t) FROM u": "nothing_selected",
    "SELECT f(a FROM t": "unbalanced_brackets",
    "SELECT a) FROM t": "unbalanced_brackets",
    "SELECT (CASE WHEN a THEN b) END FROM t": "unclosed_case",
    "SELECT a END FROM t": "unclosed_case",
    "SELECT a FROM t WHERE s = 'x": "unclosed_literal",
    "CREATE TABLE t (a INT)": "not_a_query",
    "DELETE FROM t": "not_a_query",
    "-- nothing": "not_a_query",
    "": "empty_input",
    "; ''; ": "several_statements",
}


@pytest.fixture(scope="module")
def found(spark):
    def run(texts):
        rows = repair.repaired(spark.createDataFrame([(i, "p", s) for i, s in enumerate(texts)], "query_id int, prompt string, sql string")).collect()
        return [r for r in sorted(rows, key=lambda r: r["query_id"])]

    return run


def test_whole_texts_are_left_alone(found):
    for text, row in zip(WHOLE, found(WHOLE), strict=True):
        assert (row["fault"], row["steps"], row["repaired"], row["remaining"]) == (None, [], text, None), text


def test_faults_are_named(found, spark):
    for text, row in zip(BROKEN, found(list(BROKEN)), strict=True):
        assert row["fault"] == BROKEN[text], text
    rows = statements(spark.createDataFrame([(s, "p", s) for s in BROKEN], "query_id string, prompt string, sql string")).collect()
    said = {r["query_id"]: r["parse_error"] for r in rows}
    assert all(said.values()) and said["SELECT a FROM t GROUP BY a WHERE b"] == "clause_order"


def test_null_marks_and_long_texts(found):
    long = "SELECT a FROM t WHERE a IN (" + ", ".join(str(n) for n in range(20_000)) + ")"
    rows = found([None, "\ufeffSELECT a FROM t", long, long + ";", "SELECT 1;" * 500 + "SELECT a FROM t"])
    assert [r["fault"] for r in rows] == ["empty_input", None, None, "trailing_semicolon", "several_statements"]
    assert rows[1]["repaired"] == "SELECT a FROM t" and rows[3]["repaired"] == long and rows[4]["repaired"] == "SELECT 1"


def test_steps_are_chained(found):
    rows = found(["SET a = ‘b’;\nSELECT “x” FROM t;", "CALL p('SELECT')"])
    assert rows[0]["steps"] == ["trim_trailing_semicolons", "normalize_smart_quotes", "first_statement"] and rows[0]["repaired"] == 'SELECT "x" FROM t'
    assert rows[1]["steps"] == ["strip_bq_scripting"] and rows[1]["remaining"] == "unclosed_literal"
