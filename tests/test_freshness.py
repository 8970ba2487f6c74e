"""Cached answers by their files' times."""

import datetime
import os

from pyspark.sql import functions as F

from prismatica.sources import freshness

CODES = "table string, code int, text string"


def test_files_age_and_are_replaced(spark, tmp_path):
    now = datetime.datetime(2026, 1, 2, tzinfo=datetime.timezone.utc).timestamp()
    for name, hours, text in (("new", 1, '{"columns": {"a": {"description": "x"}}}'), ("edge", 24, "{}"), ("old", 25, "{}"), ("bad", 1, "{"), ("list", 1, "[1]"), ("later", -1, "{}"), ("both", 30, '{"display_name": "old"}')):
        path = tmp_path / f"{name}.json"
        path.write_text(text)
        os.utime(path, (now - hours * 3600,) * 2)
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / "both.json").write_text('{"display_name": "young"}')
    os.utime(tmp_path / "more" / "both.json", (now - 3600,) * 2)
    (tmp_path / "notes.txt").write_text("{}")
    cached = freshness.cached_answers(spark, str(tmp_path))
    wanted = spark.createDataFrame([(t,) for t in ("new", "edge", "old", "bad", "list", "later", "both", "none", None, "new")], "table string")
    fetched = spark.createDataFrame([("old", 200, '{"description": "d"}'), ("bad", 500, "x" * 300), ("list", 200, "[2]"), ("later", 404, None), ("none", None, "timeout"), ("new", 500, "")], CODES)
    found = {r["table"]: r for r in freshness.answers(wanted, cached, fetched, F.lit("2026-01-02").cast("timestamp")).collect()}
    said = {t: (r["source"], r["status"], r["missed"], r["reason"]) for t, r in found.items()}
    assert said == {
        "new": ("cache", "success", None, None),
        "edge": ("cache", "success", None, None),
        "both": ("cache", "success", None, None),
        "old": ("api", "success", "stale", None),
        "bad": ("api", "error", "unreadable", "HTTP 500: " + "x" * 200),
        "list": ("api", "error", "unreadable", "not a JSON object"),
        "later": ("fallback", "success", "absent", "404"),
        "none": ("fallback", "success", "absent", "timeout"),
    }
    assert found["both"]["text"] == '{"display_name": "young"}'


def test_empty_tables(spark):
    none = spark.createDataFrame([], CODES)
    cached = spark.createDataFrame([], "table string, modified timestamp, text string")
    wanted = spark.createDataFrame([("cust_seg-x",)], "table string")
    found = freshness.answers(wanted, cached, none, F.current_timestamp())
    assert [tuple(r) for r in freshness.digests(found).collect()] == [("cust_seg-x", "fallback", "Cust Seg X", "", [], None, 0, 0.0)]
    assert freshness.columns(found).count() == 0 and freshness.misses(found).collect()[0]["missed"] == "absent"
    assert freshness.answers(wanted.limit(0), cached, none, F.current_timestamp()).count() == 0
