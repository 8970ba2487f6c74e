import hashlib
import random
import re
import unicodedata
from functools import reduce

import pytest

from prismatica.llm import bpe_codec, token_counts
from prismatica.llm.bpe import tokenizer_path

LETTERS = "ab \x1c\x1f\x85  \t\n\r'''sSreévVlLmdt́中123٣!?<|😀Σİ²ª\x00ςẞK"


def hostile(n):
    rnd = random.Random(1)
    for _ in range(n):
        yield "".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 30))) + rnd.choice(["", "<|endoftext|>", "<|endoftext|", "<|startoftext|>x"]) + "a" * rnd.randint(0, 40)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_codec_equals_library(library, corpus):
    codec, ours = bpe_codec.codec(tokenizer_path("byte_bpe_50k.json")), library["byte_bpe_50k.json"]
    for text in [*hostile(800), *[t or "" for _, t in corpus]]:
        ids = codec.encode(text)
        assert ids == ours.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == ours.decode(ids, skip_special_tokens=False)


def test_codec_memo_limit(library):
    small = bpe_codec.PrefixCodec(tokenizer_path("byte_bpe_50k.json"), limit=20)
    for text in hostile(150):
        assert small.encode(text) == library["byte_bpe_50k.json"].encode(text, add_special_tokens=False).ids


def chunks_of(text, size):
    """Cuts at any place where normalisation joins nothing, outside special strings."""
    inside = {i for m in re.finditer(r"<\|(end|start)oftext\|>", text) for i in range(m.start() + 1, m.end())}
    ends = [i for i in range(1, len(text)) if i not in inside and unicodedata.category(text[i])[0] != "M"][size - 1 :: size]
    return [text[a:b] for a, b in zip([0, *ends], [*ends, len(text)], strict=True)]


def closed_maps(machine, chunks):
    """Maps of chunks from the start state and every state that the chunk before ends in, guessed ones among them."""
    maps, entries = [], {machine.START}
    for i, chunk in enumerate(chunks):
        entries |= {machine.START, machine.run(machine.START, chunks[i - 1][-3:])[0]} if i else set()
        run = machine.run_to_end if i + 1 == len(chunks) else machine.run
        maps.append({e: run(e, chunk) for e in entries})
        entries = {x for x, _ in maps[-1].values()}
    return maps


def test_counts_equal_library_for_any_chunking(library, corpus):
    machine, ours = token_counts.Transducer(tokenizer_path("word_bpe_49k.json"), limit=5000), library["word_bpe_49k.json"]
    rnd = random.Random(2)
    for text in [*hostile(600), *[t or "" for _, t in corpus]]:
        want = len(ours.encode(text, add_special_tokens=False).ids)
        assert machine.count(text) == want
        maps = closed_maps(machine, chunks_of(text, rnd.randint(1, 9) if len(text) < 300 else rnd.randint(50, 400)))
        assert reduce(token_counts.compose, maps)[machine.START][1] == want


def test_composition_is_associative(library):
    machine = token_counts.transducer(tokenizer_path("word_bpe_49k.json"))
    for text in hostile(100):
        maps = closed_maps(machine, chunks_of(text, 5))
        for a, b, c in zip(maps, maps[1:], maps[2:], strict=False):
            assert token_counts.compose(token_counts.compose(a, b), c) == token_counts.compose(a, token_counts.compose(b, c))


def test_codec_frame(spark, docs, corpus, library):
    got = bpe_codec.digests(docs).collect()
    want = []
    for i, t in corpus:
        ids = library["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(library["byte_bpe_50k.json"].decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    kept = bpe_codec.encode_decode(docs.withColumnRenamed("source", "decoded"))
    assert kept.columns == ["doc_id", "text", "n_removed", "token_ids", "decoded"]
    assert bpe_codec.encode_decode(docs.limit(0)).count() == 0


def test_count_frame(spark, docs, corpus, library, monkeypatch):
    monkeypatch.setattr(token_counts, "CHUNK", 100)
    got = token_counts.token_counts(docs.select("doc_id", "text")).collect()
    want = [(i, len((t or "").encode()), n := len(library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in corpus]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert token_counts.token_counts(docs.limit(0)).count() == 0


def test_count_frame_of_hostile_chunks(spark, library, monkeypatch):
    """Cuts beside special strings, marks and Jamo; words over many chunks whose entry states can't be guessed; several scan steps."""
    monkeypatch.setattr(token_counts, "CHUNK", 7)
    monkeypatch.setattr(token_counts, "BACK", 2)
    monkeypatch.setattr(token_counts, "FAN", 3)
    rnd = random.Random(9)
    letters = LETTERS.replace(" ", "") + "\u0301\u0327\u1100\u1161\u11a8각"
    texts = ["a" * 300, "ab" * 200, "<" * 50 + "<|endoftext|>" * 20, "e" + "\u0301" * 40, "'re" * 60, *hostile(60)]
    texts += ["".join(rnd.choices(letters, k=rnd.randint(20, 90))) + rnd.choice(["", "<|endoftext|>'ll"]) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in token_counts.token_counts(frame).select("doc_id", "n_tokens").collect()}
    assert got == {i: len(library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_count_frame_of_long_texts(spark, library):
    """Widths that change at every character, over several chunks, with and without white space."""
    rnd = random.Random(6)
    texts = ["😀a中" * 40_000, "".join(rnd.choices("😀a é中\n1", k=200_000)), " " * 70_000, "x" * token_counts.CHUNK, "x " * token_counts.CHUNK]
    got = {r[0]: r[2] for r in token_counts.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).select("doc_id", "n_bytes", "n_tokens").collect()}
    assert got == {i: len(library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_counting_new_words_is_cheap(library):
    """Most time goes to words never seen before: their letters' shapes are shared by many states, and no collection walks the table."""
    import gc

    rnd = random.Random(5)
    texts = [" ".join("".join(rnd.choice("aeinrst") for _ in range(rnd.randint(2, 12))) for _ in range(200)) for _ in range(20)]
    machine, collections = token_counts.Transducer(tokenizer_path("word_bpe_49k.json")), []
    watch = lambda phase, _: collections.append(phase)
    gc.callbacks.append(watch)
    try:
        got = machine.counts(texts)
        assert collections.count("start") <= 1 and gc.isenabled()  # one may follow the last text
    finally:
        gc.callbacks.remove(watch)
    assert got == [len(library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids) for t in texts]
    assert machine.size > 10_000 and 4 * len(machine.shapes) < machine.size
