"""The pipeline's stages against the operators' plain counterparts on small tables."""

import sentencepiece

import corpus_pipeline
import public_tokenizers


def test_stages(spark, tmp_path):
    good = [" ".join(f"word{(i * 37 + j * j) % 900} and" for j in range(40)) for i in range(30)]
    junk = ["BUY!! NOW!! %%% " * 20] * 10
    rows = [(i, t, "en", "s", len(t), i) for i, t in enumerate(good + junk)]
    rows += [(100, good[0], "en", "s", 1, 0), (100, good[0], "en", "s", 1, 0), (101, good[1] + " mail ann@x.org", "en", "s", 1, 0), (102, None, "en", "s", 0, 0)]
    passage = " ".join(f"bench{j}" for j in range(20))
    rows += [(103, good[2][:200] + " " + passage, "en", "s", 1, 0), (None, "word7 and word9", None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, tails int").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 30), 0) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/out{i}")
        docs = spark.read.parquet(f"{tmp_path}/out{i}")
        kept[i] = docs.collect()
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "tails"]
    ids = [sorted((r.doc_id is None, r.doc_id or 0) for r in kept[i]) for i in range(5)]
    assert {i for _, i in ids[0]} & set(range(30, 40)) == set() and {i for _, i in ids[0]} >= set(range(30))
    assert {i for _, i in ids[1]} & {100, 101} == set() and len(ids[1]) == len(set(ids[1]))
    assert {i for _, i in ids[1]} - {i for _, i in ids[2]} == {103}
    texts = {r.doc_id: r for r in kept[3]}
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in texts.values())
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {r.doc_id: list(r.ids) for r in kept[4]} == {i: library.encode(r.text or "", add_eos=True) for i, r in texts.items()}


def test_near_copies_with_repeated_ids(spark):
    a, b, d = (" ".join(f"{c}{i}" for i in range(40)) for c in "abd")
    rows = [(1, a, 1), (2, a, 1), (3, b, 1), (3, d, 1), (3, d, 1), (3, a, 1), (None, a, 1), (5, None, 1), (5, "", 1), (6, None, None), (6, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int")
    kept = corpus_pipeline.near_copies_stage(spark, docs, "")
    assert kept.columns == docs.columns
    # Texts of one id are judged apart: only the copy of document 1 goes; equal rows are one; null ids stay.
    want = [(1, a), (3, b), (3, d), (None, a), (5, None), (5, ""), (6, None)]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0
