"""Extra columns pass through every operator, whatever their names; no internal column leaks into a result."""

import pytest
from pyspark.sql import functions as F

from prismatica.llm import bpe_codec, decontaminate, periodic_runs, quality_crf, secret_scan, substring_dedup, suffix_dedup, token_counts

NAMES = ("__text", "__doc", "__th", "__key", "__leaks", "__score", "__spans", "__data", "given", "given0", "leaks", "score_", "v", "key", "a.b", "weird`name", "user name")
TEXT = 'a token = "abcdefgh" b'


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, TEXT, 9), (2, "clean words only", 9), (3, None, 9)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    return frame.select("*", *[F.lit(f"mine {i}").alias(n) for i, n in enumerate(NAMES)])


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "nothing of this is in any document at all")], "item_id long, text string")


@pytest.mark.parametrize(
    "operator",
    [
        lambda d, _: bpe_codec.encode_decode(d),
        lambda d, _: token_counts.token_counts(d),
        lambda d, _: substring_dedup.remove_repeats(d),
        lambda d, _: suffix_dedup.repeated_spans(d),
        lambda d, _: periodic_runs.periodic_runs(d),
        lambda d, _: suffix_dedup.remove_repeats(d),
        lambda d, _: secret_scan.scan(d),
        lambda d, _: secret_scan.redact(d, "#"),
        lambda d, i: decontaminate.with_leaks(d, i, leaks="found"),
        lambda d, i: decontaminate.clean(d, i),
        lambda d, _: quality_crf.score(d, quality_crf.train([], [])),
    ],
)
def test_extra_columns_come_back(odd, items, operator):
    out = operator(odd, items)
    assert [c for c in out.columns if c in NAMES] == list(NAMES) and len(set(out.columns)) == len(out.columns)
    rows = out.collect()
    assert len(rows) == 3
    for r in rows:
        assert [r[n] for n in NAMES] == [f"mine {i}" for i in range(len(NAMES))]


def test_stages_keep_odd_columns(spark, odd, sf):
    import corpus_pipeline

    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd, sf)
        assert out.columns[: len(odd.columns)] == odd.columns, name
        assert all(r["__text"] == "mine 0" and r["a.b"] == "mine 14" for r in out.collect()), name


def test_redaction_leaks_nothing(odd):
    for row in secret_scan.redact(odd, "#").collect():
        assert "abcdefgh" not in " ".join(str(x) for x in row)
