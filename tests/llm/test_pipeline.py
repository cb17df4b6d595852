import os

import pytest

import corpus_pipeline as p

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shared(spark, folder):
    return folder


def test_stages(spark, documents, tmp_path):
    """Each stage's decisions, on rows made for it."""
    prose = ("The morning was cold and the river ran high above the stones while people walked along the bank and talked about the long winter "
             "that would not end before the first of may as they said every year to one another")
    other = "Completely different words make up this second document here about ships and harbours and trade between distant towns"
    item = "what is the capital of the small country beyond the high mountains of the north"
    rows = [(1, prose, "en"), (2, prose.upper(), "en"), (3, "12345 678", "en"), (4, None, None), (5, other, "en"),
            (6, "A new start of text, " + prose[:120] + ", and another end of it all that nobody else has", "en"),
            (7, "Question: " + item + " answer it please now", "en"), (8, "x", "en")]
    docs = documents(rows, "doc_id long, text string, lang string")
    bench = tmp_path / "benchmark.parquet"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(bench))
    sf = os.fspath(tmp_path)
    columns = docs.columns
    steps = []
    for name, stage in p.STAGES:
        docs = stage(spark, docs, sf)
        path = str(tmp_path / name)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        steps.append(docs)
        if name != p.STAGES[-1][0]:
            assert docs.columns == columns
    ids = [sorted(r.doc_id for r in s.select("doc_id").collect()) for s in steps]
    assert ids[0] == [1, 2, 5, 6, 7, 8]       # no letters, no text
    assert ids[1] == [1, 5, 6, 7, 8]          # a near copy
    assert ids[2] == ids[1]
    texts = {r.doc_id: r.text for r in steps[2].collect()}
    assert prose[:120] not in texts[6] and texts[6].startswith("A new start") and texts[1] == prose
    assert ids[3] == [1, 5, 6, 8]             # a benchmark passage
    assert ids[4] == ids[3] and all(r.n_tokens > 0 for r in steps[4].collect())


def test_run(spark):
    result = p.run(spark, SF)
    assert result.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and 0 < result.count() <= 200
    assert [n for n, _ in p.STAGES] == ["language_id", "near_dedup", "passage_dedup", "decontaminate", "bpe"]
