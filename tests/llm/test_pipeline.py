import pyarrow.parquet as pq

import corpus_pipeline
from prismatica.llm import decontaminate, minhash, quality_crf
from prismatica.llm.bpe import tokenizer_path


def test_stages_keep_columns_and_whole_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "secrets", "bpe"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf)
        assert after.columns[: len(docs.columns)] == docs.columns, name
        after = spark.createDataFrame(after.collect(), after.schema)
        assert 0 < after.count() <= before.count()
        before = after


def test_pipeline_equals_brute_force(spark, sf):
    from tokenizers import Tokenizer

    out = {r["doc_id"]: r for r in corpus_pipeline.run(spark, sf).collect()}
    table = pq.read_table(f"{sf}/documents.parquet").to_pylist()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality_crf.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    kept = [r for r in table if model.score([r["text"] or ""])[0] >= 0.3]
    sets = {r["doc_id"]: set(minhash.shingle_set(r["text"], 5).tolist()) for r in kept}
    from tests.llm.test_dedup import components

    labels = components(sets, 80)
    kept = [r for r in kept if labels[r["doc_id"]] == r["doc_id"]]
    items = decontaminate.Items([(r["item_id"], r["text"]) for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()])
    kept = [r for r in kept if not items.leaks(decontaminate.tokens_of(r["text"]))]
    assert set(out) == {r["doc_id"] for r in kept}
    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    for r in out.values():
        assert list(r["token_ids"]) == library.encode(r["text"], add_special_tokens=False).ids and r["decoded"] == r["text"]
        assert "token = \"" not in r["text"]


def test_stages_on_empty_and_null_rows(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    for rows in ([], [(None, None, None, None, None), (5, "", "en", "s", 0), (5, None, "en", "s", 0)]):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
        docs.collect()


def test_a_copy_goes_and_other_texts_of_its_id_stay(spark, sf):
    words = " ".join(f"w{i}" for i in range(30))
    rows = [(5, words, "en", "s", 1), (5, "some other text of six words", "en", "s", 1), (3, words.upper(), "en", "s", 1), (None, words, "en", "s", 1), (9, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, spark.read.parquet(f"{sf}/documents.parquet").schema)
    out = corpus_pipeline.near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in out.collect()))) == sorted(map(str, ((r[0], r[1]) for r in rows[1:])))
