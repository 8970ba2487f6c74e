import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from prismatica.llm import minhash, substring_dedup, suffix_dedup
from prismatica.llm.common import connected_components


def test_passages_equal_brute_force(spark, docs, corpus):
    out = substring_dedup.digest(docs)
    assert out.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    want = substring_dedup.brute_force(corpus)
    assert got == want and sum(v[1] > 0 for v in want.values()) > 10


def test_passages_with_null_and_equal_ids(spark):
    text = " ".join(f"w{i}" for i in range(120))
    rows = [(None, text), (4, text), (4, text + " z"), (4, text), (9, text), (8, None)]
    got = sorted(tuple(r)[:3] for r in substring_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).where("doc_id is not null").collect())
    assert got == [(4, 120, 0), (4, 120, 0), (4, 121, 0), (8, 0, 0), (9, 120, 120)]
    assert substring_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_passage_spans_and_extra_columns(spark, docs):
    out = substring_dedup.remove_repeats(docs)
    assert out.columns == ["doc_id", "source", "kept", "n_words", "n_removed", "spans"]
    assert out.where("n_removed <> aggregate(spans, 0L, (a, s) -> a + s.end - s.start)").count() == 0


@pytest.mark.parametrize("hot", [50_000, 3])
def test_byte_strings_equal_brute_force(spark, corpus, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SUFFIXES_A_TASK", 300)
    monkeypatch.setattr(suffix_dedup, "RUN_BYTES", 60_000)
    rows = [*corpus, (None, corpus[5][1]), (None, corpus[7][1][:900]), (7000, corpus[8][1]), (7000, corpus[8][1])]
    got = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = suffix_dedup.brute_force(rows)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(w[2] > 0 for w in want) > 20
    assert suffix_dedup.digest(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_windows(spark):
    text = "".join(random.Random(3).choices("abcdef ", k=150_000))
    rows = [(1, text), (2, "x" + text[:90_000]), (3, "short")]
    got = sorted(tuple(r)[:4] for r in suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string"), window=70_000).collect())
    assert got == [(1, 150_000, 90_000, 1), (2, 90_001, 90_000, 1), (3, 5, 0, 0)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), max_size=7))
def test_loser_tree_merges_and_knows_common_prefixes(runs):
    runs = [sorted((s, bytes([i])) for s in run) for i, run in enumerate(runs)]
    got = list(suffix_dedup.merged([suffix_dedup.decoded(suffix_dedup.front_coded(r)) for r in runs])) if runs else []
    assert sorted((s, p) for s, _, p in got) == sorted(x for r in runs for x in r)
    assert [s for s, _, _ in got] == sorted(s for s, _, _ in got)
    for (a, _, _), (b, common, _) in zip(got, got[1:], strict=False):
        assert common == suffix_dedup.shared(a, b)


def components(sets, hundredths):
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= hundredths * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("words", "block"), [(2, 2_000_000), (2, 200), (5, 200)])
def test_near_duplicates_equal_brute_force(spark, docs, corpus, words, block, monkeypatch):
    monkeypatch.setattr(minhash, "QUERY_SHINGLES", block)
    monkeypatch.setattr(minhash, "GROUP_SHINGLES", block)
    got = {r[0]: tuple(r)[1:4] for r in minhash.link_classes(docs, words).collect()}
    sets = {i: set(minhash.shingle_set(t, words).tolist()) for i, t in corpus}
    labels = components(sets, 80)
    assert got == {i: (len(sets[i]), labels[i], labels[i] == i) for i in sets}
    assert len(set(labels.values())) <= len(labels) - 5


def test_near_duplicates_null_ids_and_no_rows(spark):
    rows = [(None, "a b c"), (3, "A b c"), (2, "x"), (None, "solo words here"), (None, None), (7, None)]
    got = sorted(map(tuple, minhash.link_classes(spark.createDataFrame(rows, "doc_id long, text string"), 2).select("doc_id", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, 3, False), (3, 3, True), (2, 2, True), (None, None, True), (None, None, True), (7, 7, True)], key=str)
    assert minhash.link_classes(spark.createDataFrame([], "doc_id long, text string"), 2).count() == 0


def test_signature_agreement_estimates_similarity():
    rnd = random.Random(4)
    a = [rnd.getrandbits(64) for _ in range(900)]
    import numpy as np

    x, y = np.array(sorted(a[:800]), np.uint64), np.array(sorted(a[100:]), np.uint64)
    agree = (minhash.signature(x) == minhash.signature(y)).mean()
    assert abs(agree - 700 / 900) < 0.12


def test_connected_components(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(60)]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    loops = {a for a, b in edges if a == b}
    want = {x: find(x) for x in parent}
    assert {k: v for k, v in want.items() if k in got} == got
    assert set(want) - set(got) <= loops
