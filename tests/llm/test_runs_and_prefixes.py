"""Periodic runs, the prefix trie and SimHash classes against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prismatica.llm import periodic_runs, prefix_trie, simhash

SMALL = st.lists(st.integers(0, 2), max_size=30)


def lyndon(word: list) -> list[int]:
    """Distance to the next smaller suffix."""
    return [next((j for j in range(i + 1, len(word)) if word[j:] < word[i:]), len(word)) - i for i in range(len(word))]


@given(st.lists(SMALL, min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_grouping_gives_the_lyndon_array(words):
    x = [-1] + [s for w in words for s in (*w, -1)]
    got, at = periodic_runs.lyndon_array(np.array(x, np.int64)).tolist(), 1
    for w in words:
        assert got[at : at + len(w)] == lyndon(w)
        at += len(w) + 1


def periodic(rnd: random.Random) -> list[int]:
    out: list[int] = []
    for _ in range(rnd.randint(0, 5)):
        part = [rnd.randrange(rnd.choice([1, 2, 3, 30])) for _ in range(rnd.randint(1, 14))]
        out += part * rnd.randint(1, 30) if rnd.random() < 0.7 else part
        out = out[:-1] if rnd.random() < 0.3 else out
    return out


def test_runs_equal_brute_force():
    rnd, total = random.Random(3), 0
    for _ in range(400):
        texts = [periodic(rnd) for _ in range(rnd.randint(1, 4))]
        want = [periodic_runs.brute_force(t) for t in texts]
        assert periodic_runs.block_runs([np.array(t, np.int64) for t in texts]) == want
        total += sum(map(len, want))
    assert total > 1000


def test_runs_of_documents(spark, monkeypatch):
    rnd = random.Random(4)
    rows = [(i, " ".join(f"w{x}" for x in periodic(rnd))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n\t "), (103, "a " * 24), (104, "a " * 23), (None, "b c " * 12), (103, "a " * 24), (105, "é 😀 中 " * 9), (106, "A a " * 30)]
    frame = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, runs int").repartition(3)
    got = periodic_runs.periodic_runs(frame)
    assert got.columns == ["doc_id", "text", "n_words", "runs", "collapsed"]
    for r in got.collect():
        words = (r["text"] or "").encode().split()
        want = periodic_runs.brute_force(words)
        assert r["n_words"] == len(words) and [tuple(x) for x in r["runs"]] == want
        gone = {i for s, n, p in want for i in range(s + p, s + n)}
        assert r["collapsed"] == b" ".join(w for i, w in enumerate(words) if i not in gone).decode()
    digests = {}
    for r in periodic_runs.digest(frame.select("doc_id", "text")).collect():
        digests.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, digests.values())) == len(rows)
    for i, text in rows:
        words = (text or "").encode().split()
        h = zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[j if j < a else a + (j - a) % p] for j in range(n)]
        want = periodic_runs.brute_force(words)
        best = max(want, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=None)
        gone = {j for s, n, p in want for j in range(s + p, s + n)}
        r = digests[i][0]
        assert r["n_runs"] == len(want) and (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest()
    assert periodic_runs.digest(frame.select("doc_id", "text").limit(0)).count() == 0


def test_runs_of_a_very_long_text(spark):
    rnd = random.Random(5)
    plain = [f"v{rnd.randrange(10**7)}" for _ in range(40_000)]
    words = plain[:20_000] + ["x", "y", "z"] * 20_000 + plain[20_000:] + plain[:9_000] * 2
    row = periodic_runs.periodic_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string")).first()
    assert [tuple(r) for r in row["runs"]] == [(20_000, 60_000, 3)]
    assert row["collapsed"].split() == words[:20_003] + words[80_000:]


def turns_of(rows: list[tuple]) -> list[tuple[int, list[tuple[str, str]]]]:
    """Conversations with their openings, in plain Python."""
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in own.items()}
    out = []
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out.append((c, own.get(c - c % 20, [])[:h] + turns[h:]))
    return out


@pytest.mark.parametrize("block_turns", [1_000_000, 9])
def test_trie_equals_brute_force(spark, monkeypatch, block_turns):
    monkeypatch.setattr(prefix_trie, "BLOCK_TURNS", block_turns)
    rnd = random.Random(6)
    base = [[("user", f"hello {'x ' * k}{b}") for k in range(6)] for b in range(3)]
    rows = []
    for c in range(70):
        turns = base[c % 3][: rnd.randint(1, 6)] + [("assistant", f"tail {rnd.randrange(3)}") for _ in range(rnd.randint(0, 2))]
        rows += [(c, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(500, None, "user", "first of all"), (500, 0, None, None), (500, 0, "a", "tie"), (500, 0, "a", "tie"), (501, 0, "", ""), (None, 0, "user", "nobody's"), (-7, 1, "user", "negative"), (-20, 0, "user", "below")]
    rows += [(600 + k, j, "user", "the same words") for k in range(25) for j in range(4)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(3)
    got = [tuple(r) for r in prefix_trie.prefix_nodes(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == prefix_trie.brute_force(turns_of(rows))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_nodes(spark.createDataFrame([], schema)).count() == 0
    lone = next(c for c in range(21, 99) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    row = prefix_trie.prefix_nodes(spark.createDataFrame([(lone, 0, "user", "a b")], schema)).collect()
    assert [tuple(r) for r in row] == [(lone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lone).encode()).hexdigest())]


def test_trie_of_a_very_long_conversation(spark):
    rows = [(20, k, "user", f"turn {k}") for k in range(30_000)] + [(40, k, "user", f"turn {k}") for k in range(29_000)]
    got = prefix_trie.prefix_nodes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got.count() == 30_001 and got.where("n_convs = 2").agg(F.max("depth")).first()[0] == 29_000
    assert got.where("depth = 0").first()["saved_tokens"] == 58_000


def near_texts(rnd: random.Random) -> list[tuple]:
    rows, base = [], [" ".join(f"w{rnd.randrange(300)}" for _ in range(rnd.choice([3, 40, 120]))) for _ in range(60)]
    for i in range(260):
        words = rnd.choice(base).split()
        for _ in range(rnd.choice([0, 0, 1, 2])):
            words[rnd.randrange(len(words))] = f"z{rnd.randrange(99)}"
        rows.append((i, " ".join(words)))
    return rows + [(900, None), (901, ""), (902, " \n"), (903, "one"), (904, "ONE"), (905, "one two three four"), (906, "é 中 😀 ß É"), (907, base[0].upper()), (908, "x " * 500)]


@pytest.mark.parametrize(("parts", "tile"), [(1, 8192), (1, 7), (2, 16), (4, 3)])
def test_simhash_equals_brute_force(spark, parts, tile):
    rows = near_texts(random.Random(8))
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(3)
    out = simhash.near_classes(frame, parts=parts, tile=tile)
    assert out.columns == ["doc_id", "fingerprint", "component_id"]
    want = simhash.brute_force(rows)
    assert {r[0]: (r[1], r[2]) for r in out.collect()} == want
    assert len({c for _, c in want.values()}) < len({f for f, _ in want.values()})


def test_simhash_with_null_and_equal_ids(spark):
    rows = [(None, "a b c d e"), (4, "a b c d e"), (4, "q r s t u v"), (9, "q r s t u v"), (None, "never seen at all here")]
    got = sorted(((str(r[0]), r[2]) for r in simhash.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([("None", 4), ("4", 4), ("4", 4), ("9", 4), ("None", None)], key=str)
    assert simhash.near_classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_simhash_of_a_very_long_text():
    rnd = random.Random(9)
    text = " ".join(f"w{rnd.randrange(50_000)}" for _ in range(120_000))
    hashes = simhash.shingle_hashes(text, 4)
    assert len(hashes) == 119_997
    assert simhash.fingerprint(text) == sum(1 << b for b in range(64) if 2 * int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) > len(hashes))


def test_forest_joins_what_all_links_join():
    rnd = np.random.default_rng(10)
    for _ in range(30):
        values = np.unique(rnd.integers(0, 1 << 9, 60).astype(np.uint64))
        a, b = values[::2], values[1::2]
        for x, y in ((a, b), (a, a)):
            left, right = simhash.forest(x, y, 1, block=64)
            assert all(int(p ^ q).bit_count() <= 1 for p, q in zip(left, right, strict=True))
            found, want = {int(v): int(v) for v in (*x, *y)}, {int(v): int(v) for v in (*x, *y)}

            def join(known: dict, p: int, q: int) -> None:
                old, new = known[p], known[q]
                for k in known:
                    known[k] = new if known[k] == old else known[k]

            for p, q in zip(left.tolist(), right.tolist(), strict=True):
                assert found[p] != found[q]
                join(found, p, q)
            for p in x.tolist():
                for q in y.tolist():
                    if (p ^ q).bit_count() <= 1:
                        join(want, p, q)
            assert len(set(found.values())) == len(set(want.values()))
