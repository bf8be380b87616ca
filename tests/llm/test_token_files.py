import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tensorframe.llm import packing, token_files
from tensorframe.llm.queries import vocabulary

ROWS = [
    (3, "Hello  world\n\n  and \t tabs here", "x"),
    (1, "", "x"),
    (2, None, "y"),
    (3, "a second text  \n with the same id. Don't stop", "y"),
    (None, "no id", "y"),
    (9, "word " * 9000, "z"),
    (9, "word " * 9000, "z"),
    (10, "x" * 30000, "z"),
    (11, "\n lead and trail \n", None),
    (12, "CAFÉ it's 3.50 line <|endoftext|>", None),
]


def expected(name):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [2]


@pytest.mark.parametrize("name, keep_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_strings_of_special_tokens(name, keep_space):
    from tokenizers import Tokenizer

    from tensorframe.llm.wordcodes import WordCodes

    texts = ["a <|endoftext|> b", "plain", "<|startoftext|>A", "<|ENDOFTEXT|>", "x<|endoftext|>\n\n<|endoftext|>  y", "<|endoftext"]
    t = Tokenizer.from_file(vocabulary(name))
    for as_text in (False, True):
        t.encode_special_tokens = as_text
        ids, ends = WordCodes(vocabulary(name), keep_space, special_as_text=as_text).encode(texts)
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    if keep_space:
        ids, _ = WordCodes(vocabulary(name), keep_space).encode(texts[:1])
        assert [*ids.tolist(), 2] == [64, 220, 50256, 275, 2]


@pytest.mark.parametrize("bits", [1, 3, 7, 11, 15, 16, 17, 24, 31])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003).astype(np.uint32)
    assert (token_files.unpack(token_files.pack(ids, bits), bits, len(ids)) == ids).all()


def test_round_trip_and_order(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    got = token_files.token_files(docs, vocabulary("byte_bpe_50k.json"), vocabulary=50_257, end_id=2).collect()
    encode = expected("byte_bpe_50k.json")
    at = 0
    for row in sorted(got, key=lambda r: r.start):
        assert row.start == at
        at += row.n_tokens
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted([r[0] for r in ROWS], key=lambda x: -1 if x is None else x)
    assert sorted(r.ids for r in got) == sorted(np.array(encode(t), "<u4").tobytes() for _, t, _ in ROWS)


def test_random_access(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, ids string")
    from tensorframe.llm.common import new_path

    shards = token_files.write_tokens(docs, vocabulary("byte_bpe_50k.json"), vocabulary=50_257, end_id=2, path=new_path(spark, "t"))
    encode = expected("byte_bpe_50k.json")
    texts = {t for d, t, _ in ROWS if d == 10}
    for path, n, _ in shards:
        reader = token_files.ShardReader(path)
        for i in range(n):
            if reader.doc_ids[i] == 10:
                assert reader.document(i).tolist() == encode(texts.pop())
    assert not texts


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.token_files(docs, vocabulary("byte_bpe_50k.json"), vocabulary=50_257, end_id=2).collect() == []
    assert packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2).collect() == []


def test_query_equals_brute_force(spark):
    from tensorframe.llm.queries import op7_token_files, op8_hilbert_packing

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    encode, want, at = expected("byte_bpe_50k.json"), [], 0
    for d in docs:
        ids = encode(d.text)
        want.append((d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, op7_token_files(spark, sf).collect())) == want
    encode = expected("word_bpe_49k.json")
    ids = {d.doc_id: encode(d.text) for d in docs}
    pieces = op8_hilbert_packing(spark, sf).collect()
    seen = {}
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes())
        assert p.doc_tokens == len(ids[p.doc_id])
        seen.setdefault(p.doc_id, []).append((p.start, p.length))
    for d, got in seen.items():
        at = 0
        for start, n in sorted(got):
            assert start == at
            at += n
        assert at == len(ids[d])
    assert seen.keys() == ids.keys()
    check_sequences(pieces)


def check_sequences(pieces):
    by = {}
    for p in pieces:
        by.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for got in by.values():
        at = 0
        for offset, n in sorted(got):
            assert offset == at and n > 0
            at += n
        assert at <= 4096


def test_packing_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, length string")
    pieces = packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=2).collect()
    check_sequences(pieces)
    encode = expected("word_bpe_49k.json")
    assert sum(p.length for p in pieces) == sum(len(encode(t)) for _, t, _ in ROWS)
    assert sum(p.start == 0 for p in pieces) == len(ROWS)


def test_hilbert_is_a_curve():
    grid = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert(grid, 3)
    assert sorted(key) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def test_chopping_drops_the_encoder():
    import pyarrow as pa

    from tensorframe.llm import wordcodes

    path = vocabulary("word_bpe_49k.json")
    ids = [np.arange(n, dtype="<u2").tobytes() for n in (5, 9)]
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "key": [0, 0], "part": [0, 0], "width": [2, 2], "ids": ids})
    for keep in (True, False):
        held = wordcodes.word_codes(path, False, True)
        pieces = [p for b in packing.chopped(iter([batch]), 8, 0, keep) for p in b.to_pylist()]
        assert [(p["doc_id"], p["start"], p["length"], p["sequence_id"], p["offset"]) for p in pieces] == [(1, 0, 5, 0, 0), (2, 0, 3, 0, 5), (2, 3, 6, 1, 0)]
        assert (held in wordcodes._loaded.values()) is keep
