import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from sentencepiece import SentencePieceProcessor

from tensorframe.llm import merge_dropout as md
from tensorframe.llm.queries import vocabulary

MODEL = vocabulary("piece_bpe_32k.model")
TEXTS = [
    "Hello world  two", "", " ", "  lead and   trail  ", "tab\tnew\nline \n\n  x", "▁ literal ▁▁x", "Ünïcödé 漢字 😀 é", "x" * 500, "ab" * 40 + " " * 50 + "end",
    "12345 3.14 <s> </s> <unk> <0x41>", "The quick brown fox's jumping, over (the) lazy dogs!", "\u0000\u001f￿",
]


def ids_of(e, texts, keys=None):
    ids, ends = e.encode(texts, np.arange(len(texts)) if keys is None else np.array(keys))
    return [x.tolist() for x in np.split(ids, ends[:-1])]


def test_plain_encoding_is_the_librarys():
    model = SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(1)
    words = [model.id_to_piece(i).strip("▁") for i in range(300, 20000, 7)]
    texts = [t for t in TEXTS if "▁" not in t and "<" not in t] + ["".join(rng.choice(words) + rng.choice(["", " ", ", ", "\n"]) for _ in range(60)) for _ in range(200)]
    got = ids_of(md.Encoder(MODEL, 0.0, 0), texts)
    assert got == [model.encode(t) for t in texts]


def slow(v, text, key, rate):
    """Repeats: merge the best pair that is not skipped."""
    s = [(int(v.symbols[ord(c)]), i, i + 1) for i, c in enumerate(text)]
    while True:
        best = None
        for k in range(len(s) - 1):
            rank, made = v.look_up(np.array([s[k][0]]), np.array([s[k + 1][0]]))
            if rank[0] < md.NONE and not md.skipped(np.array([key], np.uint64), [s[k][1]], [s[k + 1][1]], [s[k + 1][2]], rate)[0] and (best is None or rank[0] < best[0]):
                best = rank[0], k, int(made[0])
        if best is None:
            return v.spelled([x[0] for x in s])
        _, k, made = best
        s[k : k + 2] = [(made, s[k][1], s[k + 1][2])]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0])
def test_matrix_and_agenda_equal_plain_repetition(rate):
    e = md.Encoder(MODEL, rate, 3)
    rng = random.Random(2)
    chunks = [" " + "".join(rng.choice("theriongas▁漢") for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["    x", " ", " a"]
    keys = np.array([rng.getrandbits(64) for _ in chunks], np.uint64)
    sym = [e.v.symbols[list(map(ord, t))].tolist() for t in chunks]
    matrix = np.full((len(chunks), 32), -1, np.int64)
    for i, s in enumerate(sym):
        matrix[i, : len(s)] = s
    got = {}
    for rows, made, sizes in md.merge_rows(e.v, matrix, np.array([len(s) for s in sym]), keys, rate):
        got |= {int(r): e.v.spelled(m[:n].tolist()) for r, m, n in zip(rows, made, sizes, strict=True)}
    for i, t in enumerate(chunks):
        want = slow(e.v, t, int(keys[i]), rate)
        assert got[i] == want
        assert e.v.spelled(md.agenda(e.v, sym[i], int(keys[i]), rate)) == want


def test_seeds_vary_and_texts_return():
    texts = [t.replace("\x00", "") for t in TEXTS] + ["the same words the same words " * 30]
    seen = set()
    for seed in range(4):
        e = md.Encoder(MODEL, 0.2, seed)
        ids, ends = e.encode(texts, np.arange(len(texts)))
        assert [b.decode() for b in e.decode(ids.astype(np.int64), ends)] == texts
        assert ids_of(md.Encoder(MODEL, 0.2, seed), texts) == ids_of(e, texts)
        seen.add(ids.tobytes())
    assert len(seen) == 4
    assert len(set(map(str, ids_of(e, ["the same words"] * 40)))) > 1


def test_each_occurrence_is_segmented_by_itself(monkeypatch):
    texts = [" ".join(["internationalization"] * 300)] * 4 + [t + " the " + "uncharacteristically " * 5 for t in TEXTS]
    e = md.Encoder(MODEL, 0.1, 0)
    got = ids_of(e, texts)
    cuts = [[], [], [], []]
    for t, cut in zip(got[:4], cuts, strict=True):
        spelled = b""
        for i in t:
            if spelled.endswith(b" internationalization") or not spelled:
                cut.append([])
            cut[-1].append(i)
            spelled += e.v.bytes[i]
    assert all(len(c) == 300 for c in cuts)
    assert len({str(x) for x in cuts[0]}) > 20 and len({str(x) for c in cuts for x in c}) > len({str(x) for x in cuts[0]})
    assert len({str(c) for c in cuts}) == 4
    # merging every occurrence gives what the held segmentations give
    monkeypatch.setattr(md.Encoder, "_deviating", lambda self, chunk, keys: np.arange(len(chunk)))
    assert ids_of(md.Encoder(MODEL, 0.1, 0), texts) == got


def test_small_store(monkeypatch):
    monkeypatch.setattr(md, "HELD", 3)
    e = md.Encoder(MODEL, 0.1, 0)
    assert [ids_of(e, [t], [5]) for t in TEXTS] == [ids_of(md.Encoder(MODEL, 0.1, 0), [t], [5]) for t in TEXTS]


def test_rows(spark):
    rows = [(1, "some text here", "a"), (1, "some text here", "a"), (None, None, "b"), (2, "", None), (3, "long " * 60_000, "c"), (None, "x y", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    coded = md.encode(docs, MODEL)
    got = md.decode(coded, MODEL, ids_column="ids_").collect()
    assert sorted(map(repr, [(r.doc_id, r.decoded, r.ids) for r in got])) == sorted(map(repr, rows))
    assert len({bytes(r.ids_) for r in got if r.doc_id == 1}) == 1
    assert md.encode(docs.limit(0), MODEL).collect() == []


def test_decode_keeps_a_column_of_its_name(spark):
    coded = md.encode(spark.createDataFrame([(1, "a b", "own")], "doc_id long, text string, decoded string"), MODEL)
    row = md.decode(coded, MODEL).collect()[0]
    assert (row.decoded, row.decoded_, row.text) == ("own", "a b", "a b")


FULL = (1 << 64) - 1


def mixed(x):
    """The finaliser of splitmix64 on plain integers."""
    x &= FULL
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & FULL
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & FULL
    return x ^ (x >> 31)


class Plain:
    """One chunk at a time, in plain Python: merges the best pair that is not skipped until there is none."""

    def __init__(self, rate, seed):
        model = SentencePieceProcessor(model_file=MODEL)
        self.rate, self.seed = rate, seed
        self.ids = {model.id_to_piece(i): i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
        self.score = {p: -model.get_score(i) for p, i in self.ids.items()}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]

    def chunk(self, text, key):
        s = [(("▁" if c == " " else "\0" if c == "▁" else c), i, i + 1) for i, c in enumerate(text)]
        while True:
            best = None
            for (a, i, j), (b, _, k) in zip(s, s[1:], strict=False):
                if a + b in self.ids and a in self.ids and b in self.ids and (best is None or (self.score[a + b], i) < best[:2]):
                    later = mixed(j * 0x9E3779B97F4A7C15 + k)
                    if (mixed(mixed(key + i) + later) >> 11) * 2.0**-53 >= self.rate:
                        best = self.score[a + b], i, j, k
            if best is None:
                break
            _, i, j, k = best
            at = next(n for n, x in enumerate(s) if x[1] == i)
            s[at : at + 2] = [(s[at][0] + s[at + 1][0], i, k)]
        out = []
        for p, i, j in s:
            out += [self.ids[p]] if p in self.ids else [self.byte[b] for b in text[i:j].encode()]
        return out

    def text(self, text, doc_id):
        out, own = [], mixed(doc_id + self.seed * 2_654_435_761 + 5)
        for place, c in enumerate(re.findall(" *[^ ]+| +", f" {text}") if text else []):
            name = mixed(sum(mixed(ord(x) + mixed(i + 7)) for i, x in enumerate(c)) + len(c))
            out += self.chunk(c, mixed(name + mixed(own + place)))
        return out


def test_query_equals_plain_encoder(spark):
    from tensorframe.llm.queries import op6_merge_dropout

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    plain, got = Plain(0.1, 17), op6_merge_dropout(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.text(texts[r.doc_id], r.doc_id)
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
