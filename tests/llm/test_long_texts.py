"""Very long texts, alone and twice, go through every operator that works on whole texts."""

import hashlib
import random

import numpy as np
import pytest

from prismatica.llm import chat_format, minhash, quality_crf, secret_scan, substring_dedup, suffix_dedup


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    text = " ".join(f"w{rnd.randrange(10**7)}" + ("\n" if rnd.random() < 0.02 else "") for _ in range(80_000))
    other = " ".join(f"v{rnd.randrange(10**7)}" for _ in range(60_000))
    return [(1, text), (2, text + " one more"), (3, other + ' token = "abcdefgh"'), (4, "short")]


@pytest.fixture(scope="module")
def long_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2)


def test_passages(long_docs, rows):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring_dedup.digest(long_docs).collect()}
    n = len(rows[0][1].split())
    assert got == {1: (n, 0), 2: (n + 2, n), 3: (len(rows[2][1].split()), 0), 4: (1, 0)}


def test_byte_strings(long_docs, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffix_dedup.digest(long_docs).collect()}
    n = len(rows[0][1])
    assert got == {1: (n, n, 1), 2: (n + 9, n, 1), 3: (len(rows[2][1]), 0, 0), 4: (5, 0, 0)}


def test_near_duplicates(long_docs, rows):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.link_classes(long_docs, 2).collect()}
    assert {d: c for d, (_, c) in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert got[1][0] == len({a + " " + b for a, b in zip(rows[0][1].lower().split(), rows[0][1].lower().split()[1:], strict=False)})


def test_scores(long_docs, rows):
    """The frame's scores are those of each text by itself."""
    model = quality_crf.train(["A good line of words.\nAnd one more.", "!!! $$$ ###\n@@ || !!"] * 20, [1, 0] * 20)
    got = {r["doc_id"]: r["score"] for r in quality_crf.score(long_docs, model).collect()}
    assert all(np.isclose(got[d], model.score([t])[0]) and 0 <= got[d] <= 1 for d, t in rows)


def test_secrets(long_docs, rows):
    got = {r["doc_id"]: r["spans"] for r in secret_scan.report(long_docs).collect()}
    at = rows[2][1].index("token")
    assert got[3] == f"assign:{at}:{at + 17}" and got[1] == got[4] == ""


def test_chats(spark, rows):
    frame = spark.createDataFrame([(7, 0, "user", "hi"), (7, 1, "assistant", rows[0][1] + "<|im_end|>")], "conv_id long, turn long, role string, text string")
    got = chat_format.read_back(chat_format.format_chat(frame)).first()
    assert got["loss_sha256"] == hashlib.sha256((rows[0][1] + "<|im_end|>").encode()).hexdigest() and got["n_turns"] == 2
