import hashlib

import pytest
from test_text_operators import brute_components, brute_distance, brute_fingerprint, brute_lines

import corpus_pipeline
from quintil.llm import decontaminate, quality
from quintil.llm.queries import QUERIES, TWINS, model_path


@pytest.fixture(scope="module")
def sf_dir(spark, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, g, s, len(t or ""), "extra") for i, t, g, s in corpus if i != 50]
    junk = [(1000 + i, "BUY NOW!! $$$ " * (5 + i), "en", "s0", 1, None) for i in range(12)]
    spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long, score string").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(1000 + i, 0, 0) for i in range(12)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, corpus[9][1][:200]), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_against_brute_force(spark, sf_dir):
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = quality.score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), kept=["text"])
    good = [(r.doc_id, r.text) for r in scored.collect() if r.predicted == 1]
    assert 20 < len(good) < docs.count() and not any((i or 0) >= 1000 for i, _ in good)
    cut = [(i, t) for i, t, *_ in brute_lines(good, 50)]
    components = {i: c for i, _, c in brute_components([(i, brute_fingerprint(t)) for i, t in cut if i is not None])}
    single = [(i, t) for i, t in cut if i is None or components[i] == i]
    item = decontaminate.normal(spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id = 1").first().text)
    clean = [(i, t) for i, t in single if i is None or brute_distance(item, decontaminate.normal(t)) > int(len(item) * 0.1)]
    assert len(clean) < len(single) < len(cut)
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    expected = []
    for i, t in clean:
        ids = library.encode(t or "", add_eos=True)
        expected.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()]
    assert sorted(got, key=repr) == sorted(expected, key=repr)


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, sf_dir)
        assert [(f.name, f.dataType) for f in after.schema] == [(f.name, f.dataType) for f in docs.schema]
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14)) and set(TWINS) <= set(QUERIES)
