import random

import numpy as np
import pytest

from tensorframe.llm import fm_index, substring, textwords


@pytest.mark.parametrize("letters, window", [(2, 5), (4, 5), (4, 1), (9, 3), (1, 20)])
def test_matching_statistics(letters, window):
    rng = np.random.default_rng(letters)
    sizes = rng.integers(1, 37, 60)
    words = rng.integers(0, letters, sizes.sum())
    firsts = np.cumsum(sizes) - sizes
    texts = [tuple(words[f : f + n].tolist()) for f, n in zip(firsts, sizes, strict=True)]
    keep = [i for i, t in enumerate(texts) if t not in texts[:i]]  # the index holds different texts
    sizes, texts = sizes[keep], [texts[i] for i in keep]
    words = np.concatenate([np.array(t) for t in texts])
    firsts = np.cumsum(sizes) - sizes
    places = rng.permutation(len(words))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    index = fm_index.FMIndex(words, sizes, letters, places, window)
    at, earliest = index.statistics(words, firsts, sizes, window)
    occurs = {}
    for p in range(len(words)):
        if p + window <= firsts[owner[p]] + sizes[owner[p]]:
            occurs.setdefault(tuple(words[p : p + window].tolist()), []).append(p)
    want = {p: min(places[x] for x in found) for found in occurs.values() if len(found) > 1 for p in found}
    assert dict(zip(at.tolist(), earliest.tolist(), strict=True)) == want and len(at) == len(want)
    # every rank of the transform
    order, _ = fm_index.suffix_order(np.concatenate([np.append(t, -1 - i) for i, t in enumerate(texts)]) + len(texts))
    assert sorted(order.tolist()) == list(range(index.n))


def test_near_numbers():
    x = np.array([0, 254, 255, 256, 3, 10**6])
    assert fm_index.Near(x)[np.array([5, 0, 2, 1, 3, 4, 5])].tolist() == [10**6, 0, 255, 254, 256, 3, 10**6]


def thue_morse(n):
    a, b = "a", "b"
    while len(a) < n:
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("n", [1024, 2048, 4096, 8192])
def test_words_that_a_polynomial_hash_confuses(spark, n):
    x, y = thue_morse(n)
    first = " ".join(f"p{i}" for i in range(19))
    assert len(set(textwords.words_of([x, y])[0].tolist())) == 2
    got = substring.drop_repeats(spark.createDataFrame([(1, f"{first} {x}"), (2, f"{first} {y}"), (3, f"{first} {y}")], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in got) == [(1, 0), (2, 0), (3, 20)]


def test_equal_hashes_are_not_equal_segments(monkeypatch):
    """All words have one of eight hashes; segments that count as copies still hold the same words."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(100)]
    rows = [(i, t) for i, t in enumerate(near_copies(rng, 12, vocabulary, base) + [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(12)])]
    few = lambda self, seed=0: (np.array([len(self.raw[a:b]) + self.raw[b - 1] for a, b in zip(self.starts, self.ends, strict=True)], np.uint64)) % np.uint64(8)
    words, texts = textwords.Words, [t.encode() for _, t in rows]
    monkeypatch.setattr(words, "hashes", few)
    ids = np.arange(len(rows))
    s = substring.Segments(words(texts), ids, 20)
    seen = [tuple(b" ".join(texts).split()[a : a + n + 19]) for a, n in zip(s.at[s.order], s.n[s.order], strict=True)]
    assert all(a == b for a, b, new in zip(seen, seen[1:], s.new[1:], strict=False) if not new)


def test_words_of():
    texts = ["a b\tc", "", "  ", "b a  x", "é é"]
    hashes, counts = textwords.words_of(texts)
    assert counts.tolist() == [3, 0, 0, 2, 2]
    assert hashes[5] == hashes[6] and len(set(hashes.tolist())) == 6


def brute(rows, window):
    """rows in order: words kept of each."""
    seen, out = {}, []
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    words = {k: (rows[k][1] or "").encode().split() for k in order}
    for k in order:
        for i in range(len(words[k]) - window + 1):
            seen.setdefault(tuple(words[k][i : i + window]), (k, i))
    for k, row in enumerate(rows):
        gone = {j for i in range(len(words[k]) - window + 1) if seen[tuple(words[k][i : i + window])] != (k, i) for j in range(i, i + window)}
        out.append((row[0], len(words[k]), len(gone), b" ".join(w for i, w in enumerate(words[k]) if i not in gone)))
    return out


def near_copies(rng, n, vocabulary, base):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w))
            w[i : i + rng.randrange(3)] = [rng.choice(vocabulary)] * rng.randrange(3)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed, many, group, chunk", [(0, 128, 4_000_000, 400_000), (1, 2, 1500, 400), (2, 0, 1, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, many, group, chunk):
    monkeypatch.setattr(substring, "MANY", many)
    monkeypatch.setattr(substring, "GROUP", group)
    monkeypatch.setattr(substring, "CHUNK", chunk)
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    passage = [rng.choice(vocabulary) for _ in range(26)]
    texts = near_copies(rng, 25, vocabulary, base)
    texts += [" ".join([rng.choice(vocabulary) for _ in range(rng.randrange(60))] + passage + [rng.choice(vocabulary) for _ in range(rng.randrange(60))]) for _ in range(15)]
    texts += ["again " * 300, "again " * 290 + "and " * 70, "x y " * 90, "a b c d e " * 5, "f g h " * 9 + "i", "one two three four five six seven " * 4, " odd  space\n" * 30, "", None, "short text", " ".join(base), " ".join(base)]
    rng.shuffle(texts)
    ids = [rng.randrange(1000) for _ in texts]
    ids[3], ids[4], ids[5] = None, ids[6], ids[7]
    rows = [(i, t, "x") for i, t in zip(ids, texts, strict=True)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string").coalesce(1)
    got = [(r.doc_id, r.n_words, r.n_removed, bytes(r.kept_)) for r in substring.drop_repeats(df).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows, 20), key=repr)
    several = spark.createDataFrame(rows, "doc_id long, text string, kept string").repartition(5)
    unique = [r for r in rows if ids.count(r[0]) == 1]
    got = {r.doc_id: (r.n_removed, bytes(r.kept_)) for r in substring.drop_repeats(several.filter(f"doc_id in ({','.join(str(r[0]) for r in unique if r[0] is not None)})")).collect()}
    assert got == {d: (n, k) for d, _, n, k in brute([r for r in unique if r[0] is not None], 20)}


def test_columns_of_many_kinds_pass_through(spark):
    df = spark.sql("select 1L doc_id, 'a b' text, timestamp '2020-01-02 03:04:05.678901' t, date '2020-01-01' d, cast(1.5 as decimal(20,3)) x, array(1, null) l, map('k', 2) m, named_struct('a', 1, 'b', 'z') s, cast(null as binary) b")
    row = substring.drop_repeats(df).drop("n_words", "n_removed", "kept").collect()[0]
    assert row == df.collect()[0]


def test_empty_table(spark):
    assert substring.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
