import zlib

import numpy as np

import corpus_pipeline as cp
from tests.llm import test_near_dedup, test_pii, test_substring
from tensorframe.llm import pii, quality_gam
from tensorframe.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


def test_stages_equal_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality_gam.train(docs, labels)
    want = {d: t for d, t in rows.items() if model.score(quality_gam.features([t]))[0] >= 0.5}
    assert 0 < len(want) < len(rows)
    found, per_stage = docs, []
    for _, stage in cp.STAGES:
        found = cp.written(stage(spark, found, SF), "test")
        per_stage.append(found)
    got = {r.doc_id: r.text for r in per_stage[0].collect()}
    assert got == want
    classes = dict(test_near_dedup.brute(list(want.items()), 0.8))
    kept = {r.doc_id: r.text for r in per_stage[1].collect()}
    assert kept == {d: t for d, t in want.items() if classes[d] == d}
    left = {d: (k.decode() if gone else kept[d]) for d, n, gone, k in test_substring.brute(list(kept.items()), 20) if not gone or gone < n}
    got = per_stage[2].collect()
    assert {r.doc_id: r.text for r in got} == left and all(r.n_chars == len(r.text) for r in got)
    got = {r.doc_id: r.text for r in per_stage[3].collect()}
    assert got.keys() == left.keys()
    for d, t in left.items():
        assert got[d] == t or test_pii.plain(t) or pii.find_spans([t])[1][0]
        for a, _, b in test_pii.plain(t):
            assert t[a:b] not in got[d]
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {d: t.encode(x, add_special_tokens=False).ids + [2] for d, x in got.items()}
    pieces = per_stage[4].collect()
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
    for one in per_stage[:4]:
        assert one.columns == docs.columns


def test_odd_rows(spark, tmp_path):
    rows = [(1, "some words in a row here", "en", "s", 24, "x"), (1, "some words in a row here", "en", "s", 24, "x"), (None, None, None, None, None, "x"), (None, "no id", "en", "s", 5, "x"), (2, "", "en", "s", 0, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words string"
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = cp.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == [(False, 1), (False, 2), (True, 0), (True, 0)]
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_rows_of_one_doc_id_and_other_texts_stay(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abc"]
    rows = [(1, texts[0], "en", "s", 1, "y"), (1, texts[1], "en", "s", 1, "x"), (1, texts[1], "en", "s", 1, "w"), (2, texts[1], "en", "s", 1, "z"), (2, texts[2], "en", "s", 1, "z"), (4, None, "en", "s", 0, "n"), (4, "", "en", "s", 0, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, h string")
    got = cp.near_copies(spark, docs, "").collect()
    assert sorted(((r.doc_id, r.text, r.h) for r in got), key=repr) == sorted([(1, texts[0], "y"), (1, texts[1], "w"), (2, texts[2], "z"), (4, None, "n")], key=repr) and got[0].__fields__ == docs.columns
