import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tensorframe.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(text):
    """The contract's patterns read literally."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(EMAIL, text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(IP, text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(CARD, text):
        d = re.sub("[ -]", "", m[0])
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(PHONE, text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1 0.@_+-()4x2", max_size=60))
def test_base_spans_are_the_patterns(text):
    assert pii.base_spans(text) == plain(text)


def spans(text):
    base, added = pii.find_spans([text])
    return [(pii.KINDS[k], text[a:b]) for a, k, b in added[0]]


def test_repeated_number_is_found_again():
    assert spans("Call +1 (658) 555-3225 now. Later 658 555 3225 again") == [("phone", "658 555 3225")]
    assert spans("jo12@mail.example.com wrote; jo12@example did not") == [("email", "jo12@example")]


def test_plain_numbers_are_left_alone():
    for text in ("order 658-555-3225", "in 2021-03-04 12 there were 1000000", "Licensed under CC BY-NC 4.0", "a" * 100_000, "1" * 100_000, "word " * 1000):
        assert spans(text) == []


def test_numbers_side_by_side():
    assert spans("call +1 (269) 555-3296 4524132264652876 and on") == [("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")]
    assert spans("x +1 (269) 555-3296 4524132264652877 y") == [("phone", "+1 (269) 555-3296")]
    assert spans("paid with 4111 1111 1111 1111 123 today") == [("card", "4111 1111 1111 1111")]


def test_candidates_have_no_length_limit():
    long, name = "1" * 500, "n" * 300
    text = f"a {long} b {name}@{name} c@d@e@ @f g@"
    found = [text[a:b] for a, b in pii.candidates(text, [])]
    assert found == [long, f"{name}@{name}", "c@d"]
    assert [("1 " * 40)[a:b].count("1") for a, b in pii.candidates("1 " * 40, [])] == [pii.ALONE] * 3


def test_evidence_goes_as_far_as_the_document():
    """Every later mention counts, however many lie between it and the observed one."""
    text = "Call +1 (658) 555-3225. " + "Then 658 555 3225 it was. " * 60
    assert spans(text) == [("phone", "658 555 3225")] * 60


def test_skip_edges_add_what_the_chain_does_not():
    import numpy as np

    rng = np.random.default_rng(3)
    texts = []
    for i in range(60):
        area, middle, end = rng.integers(200, 999, 2).tolist() + [int(rng.integers(1000, 9999))]
        gap = "some other words that go on for a while, longer than neighbours may be apart, " * int(rng.integers(1, 4))
        texts.append(f"Reach +1 ({area}) {middle}-{end} by day. {gap} Or {area} {middle} {end} {gap} and {area}.{middle}.{end} once more")
        texts.append(f"order {area} {middle} {end} {gap} and {area}.{middle}.{end} once more, +1 ({end % 900 + 100}) {area}-{end}")
    got = pii.field_report(texts)
    assert got["free"] == 240 and got["added"] == 120 and got["added by the chain alone"] == 0
    assert sum(got["marginals"]) == 240


def test_messages_settle_in_cycles():
    import numpy as np

    rng = np.random.default_rng(1)
    field = pii.Field()
    field.on, field.label = [[0, 4, 17]] * 40, [4] + [-1] * 39
    field.edges = sorted({(int(rng.integers(2)), *sorted(rng.choice(40, 2, replace=False).tolist())) for _ in range(120)})
    p = field.marginals(pii.trained())
    longer = pii.SETTLED
    try:
        pii.SETTLED = 1e-9
        assert np.allclose(p, field.marginals(pii.trained()), atol=1e-3)
    finally:
        pii.SETTLED = longer


def test_long_runs_are_linear():
    pii.find_spans(["1 " * 300_000, "+1 (234) 555-1234 " * 20_000, "a@b " * 200_000, "1234567 " * 30_000])
    pii.find_spans(["a" * 2_000_000, "1" * 2_000_000, "1." * 500_000, "+" * 500_000, "@" * 500_000, "a@" * 300_000])


def test_messages_equal_enumeration_on_a_tree():
    import itertools

    import numpy as np

    field = pii.Field()
    text = "+1 (658) 555-3225 or 658 555 3225, order 1234567"
    base = pii.base_spans(text)
    free = pii.candidates(text, base)
    field.add(text, base, free)
    field.edges = field.edges[: len(field.on) - 1]
    unary, pair = pii.trained()
    score = field.matrix() @ unary
    total = np.zeros(score.shape)
    for labels in itertools.product(range(pii.LABELS), repeat=len(score)):
        if any(seen >= 0 and seen != y for seen, y in zip(field.label, labels, strict=True)):
            continue
        p = np.exp(sum(score[i, y] for i, y in enumerate(labels)) - sum(score[i, s] for i, s in enumerate(field.label) if s >= 0) + sum(pair[k, labels[a], labels[b]] for k, a, b in field.edges))
        for i, y in enumerate(labels):
            total[i, y] += p
    assert np.allclose(total / total.sum(axis=1, keepdims=True), field.marginals(pii.trained()), atol=1e-3)


def test_rows_kept_and_masked(spark):
    rows = [(1, "mail a.b@c.de, host 10.0.0.1", "s"), (1, "mail a.b@c.de, host 10.0.0.1", "s"), (None, None, "s"), (2, "", None), (3, "x" * 200_000 + " 4111 1111 1111 1111", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    found = {r.doc_id: [(s.kind, s.start, s.end, s.base) for s in r.spans] for r in pii.find(docs).collect()}
    assert found == {1: [("email", 5, 13, True), ("ip", 20, 28, True)], None: [], 2: [], 3: [("card", 200_001, 200_020, True)]}
    got = [tuple(r) for r in pii.mask(docs).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, "mail <email>, host <ip>", "s")] * 2 + [(None, None, "s"), (2, "", None), (3, "x" * 200_000 + " <card>", "t")]))
    assert pii.find(docs.limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    from tensorframe.llm.queries import op9_crf_pii

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op9_crf_pii(spark, sf).collect():
        want = plain(texts[r.doc_id])
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[1] == k for x in want) for k in range(4)]
        base, added = pii.find_spans([texts[r.doc_id]])
        every = sorted([(a, k, b) for a, k, b in want] + added[0])
        assert r.spans == ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in every) and r.n_added == len(added[0])
        assert all(b <= x or y <= a for a, _, b in added[0] for x, _, y in want)
