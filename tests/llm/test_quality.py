import zlib

import numpy as np
import pytest

from tensorframe.llm import quality_gam as q


def test_additive_tables_and_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((6000, len(q.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # nothing without a pair
    model = q.fit(x[:4000], y[:4000])
    assert (1, 0) in [p[:2] for p in model.pairs]
    assert ((model.score(x[4000:]) >= 0.5) == y[4000:]).mean() > 0.95
    total = np.full(2000, model.intercept)
    for i, row in enumerate(x[4000:]):
        for j, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True)):
            total[i] += t[sum(row[j] >= v for v in c)]
        for a, b, ca, cb, t in model.pairs:
            total[i] += t[sum(row[a] >= v for v in ca), sum(row[b] >= v for v in cb)]
    assert np.allclose(total, model.raw(x[4000:]))


def test_features_of_odd_texts():
    f = q.features(["", "   \n", "a", "The end.", "é" * 10, "x" * 300_000, "\U0001f600 ok", "A\nA\nA"])
    assert np.isfinite(f).all() and (f[0] == 0).all()
    names = dict(zip(q.FEATURES, f[3], strict=True))
    assert names["letters"] == 6 / 8 and names["upper"] == 1 / 6 and names["sentence_marks"] == 1 / 8
    assert dict(zip(q.FEATURES, f[7], strict=True))["repeated_lines"] == pytest.approx(2 / 3)


def test_odd_tables(spark):
    docs = spark.createDataFrame([(1, "some text", "s"), (1, "some text", "s"), (None, None, "s"), (2, "", None)], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = q.train(docs, none)
    got = q.score(docs, model).collect()
    assert [r[3] for r in got] == [0.5] * 4 and got[0].asDict().keys() == {"doc_id", "text", "score", "score_"}
    one = q.train(docs, spark.createDataFrame([(1, 1), (2, 1), (2, None), (None, 0), (99, 0)], "doc_id long, quality int"))
    assert all(s > 0.5 for s in one.score(q.features(["x", ""])))
    assert q.score(docs.limit(0), model).collect() == []


def test_query_held_out(spark):
    from tensorframe.llm.queries import op1_additive_quality

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op1_additive_quality(spark, sf).collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for d, r in got.items())
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([got[r.doc_id].predicted == r.quality for r in labels]) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    wrong = labels.withColumn("quality", F.when(q.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = q.train(docs, labels), q.train(docs, wrong)
    assert a.intercept == b.intercept and all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def plain_features(text):
    """The features of one text, character by character."""
    from collections import Counter
    from math import log1p

    kind = Counter()
    for c in text:
        mark = c in ".,;:'\"-()"
        loud = c in "!?¡¿"
        kind["mark" if mark else "loud" if loud else "upper" if c.isupper() else "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else "other"] += 1
    n, letters = len(text), kind["upper"] + kind["letter"]
    out = [log1p(n), letters / max(n, 1), kind["upper"] / max(letters, 1), *(kind[k] / max(n, 1) for k in ("digit", "space", "mark", "loud", "other"))]
    words = text.split()
    if not words:
        return out + [0.0] * 8
    lines, w, seen = [x for x in text.split("\n") if x], len(words), Counter(words)
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return out + [n / w, log1p(n / max(len(lines), 1)), len(seen) / w, log1p(len(seen)) / log1p(w), same / w, max(seen.values()) / w, 1 - len(set(lines)) / max(len(lines), 1), (kind["other"] + kind["loud"]) / w]


def test_query_equals_plain_additions(spark):
    from math import exp

    from tensorframe.llm.queries import op1_additive_quality

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = q.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r.doc_id: r.score for r in op1_additive_quality(spark, sf).collect()}
    assert len(got) == docs.count()
    for r in docs.collect():
        x = plain_features(r.text or "")
        total = model.intercept + sum(t[sum(v <= x[j] for v in c)] for j, (c, t) in enumerate(zip(model.cuts, model.tables, strict=True)))
        total += sum(t[sum(v <= x[a] for v in ca), sum(v <= x[b] for v in cb)] for a, b, ca, cb, t in model.pairs)
        assert got[r.doc_id] == pytest.approx(1 / (1 + exp(-total)), abs=1e-9)
