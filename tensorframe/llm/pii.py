"""Personal data: fixed patterns, extended by a skip-chain conditional random field.

Base spans come from four patterns (email, ip, card, phone). Further places
that look like one — number groups of seven digits or more, words holding "@" —
are nodes of a conditional random field over each document, beside the base
spans, whose labels are observed. Edges join

* neighbours in the text (at most CHAIN_GAP characters apart), and
* each node with the first one of equal key, an observed one if there is any: the key is the last ten digits,
  or the part before "@" in lower case (the skip edges; so every mention is as near to the evidence as the next).

Loopy message passing, until no message changes by more than SETTLED, gives every free node its marginal; one
whose marginal for a kind reaches THRESHOLD is added as a span of that kind. So a number
written once as "+1 (658) 555-3225" is found again as "658 555 3225", and a phone number right before a
card number, which the patterns take for one number of too many digits, is found as two.

Weights are trained here by pseudo-likelihood on documents generated from
fixed templates that follow the forms met in web text; nothing is fitted to the corpus.

Null and empty texts have no spans. Repeated rows are handled one by one; null
doc_ids are kept; other columns pass through ``mask`` and are ignored by
``find``. Work is linear in the text also for long runs of one character.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, text_slices

KINDS = ("email", "ip", "card", "phone")
CHAIN_GAP, DAMPING, THRESHOLD, SETTLED = 40, 0.3, 0.9, 1e-5

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start where a digit run starts, as a run is taken whole.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANY = re.compile(r"[0-9@]")
DIGIT = re.compile(r"[0-9]")
#: A stretch of number groups, and a group.
NUMBERS = re.compile(r"(?<![0-9A-Za-z])[+(]{0,2}[0-9][0-9().\x20-]*(?<=[0-9)])(?![0-9A-Za-z])")
GROUP = re.compile(r"[^\x20]+")
#: A group of so many digits is a number by itself; no number has more than MOST unless it is one group.
ALONE, MOST = 12, 19

# Words that announce a kind, or something else.
CONTEXT = {
    "phone": {"call", "tel", "telephone", "phone", "fax", "mobile", "cell", "whatsapp"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit"},
    "ip": {"ip", "host", "server", "address"},
    "email": {"mail", "email", "e-mail", "contact", "write"},
    "other": {"order", "no", "id", "isbn", "version", "invoice", "number", "ref", "page", "total", "item"},
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches, found from each "@" so that long runs of letters cost nothing."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            last = m.end()
            found.append((start, last))
        else:
            last = max(last, at + 1)
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "") if m.end() - m.start() >= 14 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(found)


# ---- the random field

LABELS = 1 + len(KINDS)  # 0: none
FEATURES = 26


def numbers(text: str, first: int, last: int) -> list[tuple[int, int]]:
    """Cuts a stretch of number groups into numbers: before "+", around long groups, and after groups of four that are followed by another length."""
    out: list[tuple[int, int]] = []
    start = end = digits = 0
    fours = True
    for m in GROUP.finditer(text, first, last):
        n = sum(map(str.isdigit, m[0]))
        if not n:
            continue
        cut = m[0][0] == "+" or n >= ALONE or digits + n > MOST or digits >= ALONE and (fours and len(m[0]) != 4 or not fours) or m[0][0] == "(" and digits >= 7
        if digits and cut:
            out.append((start, end))
            digits = 0
        if not digits:
            start, fours = m.start(), True
        end, digits, fours = m.end(), digits + n, fours and len(m[0]) == 4
        if n >= ALONE:
            out.append((start, end))
            digits = 0
    return out + [(start, end)] * (digits > 0)


def handles(text: str) -> list[tuple[int, int]]:
    """Words around an "@", left to right, not overlapping."""
    out = []
    if "@" in text:
        for m in re.finditer(r"\S+", text):
            parts, at, i = m[0].split("@") if "@" in m[0] else [], m.start(), 0
            while i + 1 < len(parts):
                if parts[i] and parts[i + 1]:
                    end = at + len(parts[i]) + 1 + len(parts[i + 1])
                    out.append((at, end))
                    at, i = end + 1, i + 2
                else:
                    at, i = at + len(parts[i]) + 1, i + 1
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Places outside base spans that may be personal data."""
    out, k = [], 0
    places = [p for m in NUMBERS.finditer(text) for p in numbers(text, m.start(), m.end())] + handles(text)
    for a, b in sorted(places):
        while k < len(base) and base[k][2] <= a:
            k += 1
        if any(x[0] < b and x[2] > a for x in base[max(0, k - 4) : k + 8]):
            continue
        if "@" in text[a:b] or sum(map(str.isdigit, text[a:b])) >= 7:
            out.append((a, b))
    return out


def key(token: str) -> str:
    if "@" in token:
        return token.partition("@")[0].lower()
    digits = "".join(filter(str.isdigit, token))
    return digits[-10:] if len(digits) >= 7 else token


def features(text: str, a: int, b: int) -> list[int]:
    """Numbers of the binary features that hold at text[a:b]."""
    token = text[a:b]
    n = sum(map(str.isdigit, token))
    before = re.findall(r"[^\W\d_]+(?:-[^\W\d_]+)?", text[max(0, a - 24) : a].lower())[-2:]
    on = [0, 1 + min(6, max(0, (n - 6) // 2))]  # the digits, in steps of two
    on += [8] * ("@" in token) + [9] * token.startswith("+") + [10] * ("(" in token) + [11] * (token.count(".") == 3) + [12] * (token.count(".") not in (0, 3))
    on += [13] * ("-" in token) + [14] * (" " in token) + [15] * (14 <= n <= 19 and luhn("".join(filter(str.isdigit, token)))) + [16] * (n == len(token))
    on += [17] * bool(re.fullmatch(r"[+(]*(?:1[ .-]*)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{4}", token)) + [18] * bool(re.fullmatch(r"[0-9]{4}[-. ][0-9]{2}[-. ][0-9]{2}.*|[0-9]{2}\.[0-9]{2}\.[0-9]{4}.*", token))
    on += [19] * bool(DOMAIN.search(token.partition("@")[2]))
    return on + [20 + i for i, words in enumerate(CONTEXT.values()) if words.intersection(before)]


class Field:
    """Nodes of many documents with their unary scores and edges."""

    def __init__(self):
        self.on: list[list[int]] = []
        self.label: list[int] = []  # observed label, -1: free
        self.edges: list[tuple[int, int, int]] = []  # kind of edge (0 chain, 1 skip), two nodes

    def add(self, text: str, base, free) -> list[int]:
        """Adds a document; returns the numbers of its free nodes."""
        nodes = sorted([(a, b, k + 1) for a, k, b in base] + [(a, b, -1) for a, b in free])
        first, hub, out = len(self.on), {}, []
        for i, (a, b, label) in enumerate(nodes, first):
            name = key(text[a:b])
            if name not in hub or label >= 0 > nodes[hub[name] - first][2]:
                hub[name] = i
        for i, (a, b, label) in enumerate(nodes, first):
            self.on.append(features(text, a, b))
            self.label.append(label)
            if label < 0:
                out.append(i)
            if i > first and a - nodes[i - first - 1][1] <= CHAIN_GAP:
                self.edges.append((0, i - 1, i))
            if (j := hub[key(text[a:b])]) != i:
                self.edges.append((1, j, i))
        return out

    def matrix(self) -> np.ndarray:
        x = np.zeros((len(self.on), FEATURES))
        for i, on in enumerate(self.on):
            x[i, on] = 1
        return x

    def without(self, kind: int) -> Field:
        """The same field without its edges of a kind."""
        out = Field()
        out.on, out.label, out.edges = self.on, self.label, [e for e in self.edges if e[0] != kind]
        return out

    def marginals(self, weights: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Sum-product message passing on the loopy graph, all documents at once; only edges that still change are passed on."""
        unary, pair = weights
        score = self.matrix() @ unary
        seen = np.array(self.label)
        score[seen >= 0] = -30.0
        score[seen >= 0, seen[seen >= 0]] = 0.0
        if not self.edges:
            return softmax(score)
        kind, a, b = np.array(self.edges).T
        src, dst = np.concatenate([a, b]), np.concatenate([b, a])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        psi = pair[np.concatenate([kind, kind])]
        message = np.zeros((len(src), LABELS))
        total = score.copy()  # with all messages into a node
        active = np.arange(len(src))
        for _ in range(2 * len(score) + 200):  # far beyond what settles; evidence fades along an edge
            into = (total[src[active]] - message[back[active]])[:, :, None] + psi[active]
            top = into.max(axis=1, keepdims=True)
            new = np.log(np.exp(into - top).sum(axis=1)) + top[:, 0]
            new -= new.max(axis=1, keepdims=True)
            change = (1 - DAMPING) * (new - message[active])
            message[active] += change
            np.add.at(total, dst[active], change)
            moved = np.zeros(len(score), bool)
            moved[dst[active[np.abs(change).max(axis=1) > SETTLED]]] = True
            again = np.abs(change).max(axis=1) > SETTLED  # damped edges go on by themselves
            onward = moved[src]
            onward[active[again]] = True
            active = np.flatnonzero(onward)
            if not len(active):
                break
        return softmax(total)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def lessons(count: int = 900, seed: int = 5) -> list[tuple[str, list[tuple[int, int]], list[int]]]:
    """Generated documents: text, free places, their labels."""
    rng = np.random.default_rng(seed)
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[rng.integers(len(x))]
    out = []
    for _ in range(count):
        parts: list[tuple] = []  # text, label (-1: filler or base); or what goes before it, label, text
        area, middle, end = number(3), number(3), number(4)
        bare = pick(f"{area}-{middle}-{end}", f"({area}) {middle}-{end}", f"{area} {middle} {end}", f"{area}.{middle}.{end}", f"{area}{middle}{end}")
        user = pick("ana", "b.smith", "jo") + number(2)
        card = number(15)
        card += next(d for d in "0123456789" if luhn(card + d))
        case = rng.integers(13)
        if case == 0:  # a phone, and the same again without its country code
            parts += [(f"+1 ({area}) {middle}-{end}", -1)]
            parts += [(pick("and later", "or", "so it is", "much later, after a good many other words, again"), -1), (bare, 4)] * int(rng.integers(1, 7))
        elif case == 1:  # looks alike, but of nobody known
            parts += [(f"+1 ({number(3)}) {number(3)}-{number(4)}", -1)] * int(rng.integers(2))
            parts += [(pick("order", "ref", "item", "from", "later"), -1), (bare, 0)]
        elif case == 2:
            parts += [(pick("call", "tel", "phone"), -1), (bare, 4)]
        elif case == 3:
            parts += [(f"{user}@mail.example.com", -1)]
            parts += [(pick("also", "much later, after a good many other words, again"), -1), (f"{user}@example", 1)] * int(rng.integers(1, 7))
        elif case == 4:
            parts += [(f"{pick('kim', 'lee')}{number(2)}@mail.example.com", -1)] * int(rng.integers(2))
            parts += [("see", -1), (f"{user}@{pick('home', 'example', 'work')}", 0)]
        elif case == 5:
            parts += [(pick("on", "since"), -1), (pick(f"20{number(2)}-0{number(1)}-1{number(1)} 1{number(1)}", f"1{number(1)}.0{number(1)}.20{number(2)}"), 0)]
        elif case == 6:  # a card number that fails its check, beside data that is personal
            wrong = card[:-1] + str((int(card[-1]) + int(rng.integers(1, 10))) % 10)
            parts += [(f"{number(2)}.1{number(1)}.17.{number(2)}", -1)] * int(rng.integers(2)) + [(pick("of", "the", "number"), -1), (wrong, 0)]
        elif case == 7:
            parts += [(pick("in all", "total"), -1), (number(int(rng.integers(7, 13))), 0)]
        elif case == 8:
            parts += [(f"+44 20 {number(4)} {end}", -1), ("nothing", -1), (number(12), 0)]
        elif case == 9:  # too many digits for one pattern: a phone right before a card
            parts += [("", 4, f"+1 ({area}) {middle}-{end}"), (" ", 3, card)]
        elif case == 10:  # a card and its date or code
            shown = pick(card, " ".join(card[i : i + 4] for i in range(0, 16, 4)))
            parts += [(pick("card", "paid", "with"), -1), ("", 3, shown), (" ", -1, number(int(rng.integers(2, 5))))]
        elif case == 11:  # an account that is named as a card before, and later among other digits
            parts += [(card, -1), (pick("then", "again"), -1), ("", 3, card), (" ", -1, number(4))]
        else:  # codes that come again and again
            code = number(int(rng.integers(7, 14)))
            parts += [(pick("order", "item", "ref", "much later, after a good many other words, again"), -1), (code, 0)] * int(rng.integers(1, 7))
        text, labels = "", {}
        for part in parts:
            if len(part) == 2:  # with words before it
                text += pick(" the ", " of and ", ". Then ") if text else ""
            else:
                text += part[0] or " "
            labels[len(text)] = part[1]
            text += part[0] if len(part) == 2 else part[2]
        free = candidates(text, base_spans(text))
        if free and all(labels.get(a, -1) >= 0 for a, _ in free):
            out.append((text, free, [labels[a] for a, _ in free]))
    return out


@cache
def trained() -> tuple[np.ndarray, np.ndarray]:
    """Unary weights (features x labels) and edge potentials (kinds x labels x labels), by pseudo-likelihood."""
    field, truth = Field(), {}
    for text, free, labels in lessons():
        truth |= dict(zip(field.add(text, base_spans(text), free), labels, strict=True))
    full = np.array([truth.get(i, y) for i, y in enumerate(field.label)])
    near = np.zeros((len(full), 2 * LABELS))  # labels of the neighbours by kind of edge
    for kind, a, b in field.edges:
        near[a, kind * LABELS + full[b]] += 1
        near[b, kind * LABELS + full[a]] += 1
    rows = np.array(sorted(truth))
    x = np.hstack([field.matrix(), near])[rows]
    y = np.eye(LABELS)[full[rows]]
    w = np.zeros((x.shape[1], LABELS))
    for _ in range(4000):
        w -= 1.0 * (x.T @ (softmax(x @ w) - y) / len(x) + 2e-5 * w)
    pair = w[FEATURES:].reshape(2, LABELS, LABELS)
    return w[:FEATURES], (pair + pair.transpose(0, 2, 1)) / 2


def field_of(texts: list[str], base: list[list[tuple[int, int, int]]]) -> tuple[Field, list[tuple[int, int, int, int]]]:
    """The field over all texts, and its free nodes: text, start, end, number."""
    field, free = Field(), []
    for i, t in enumerate(texts):
        if ANY.search(t) and (places := candidates(t, base[i])):
            free += [(i, a, b, n) for n, (a, b) in zip(field.add(t, base[i], places), places, strict=True)]
    return field, free


def find_spans(texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """Base spans and added spans of each text as (start, kind number, end)."""
    base = [base_spans(t) if ANY.search(t) else [] for t in texts]
    added: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    field, free = field_of(texts, base)
    if free:
        p = field.marginals(trained())
        for i, a, b, n in free:
            label = int(p[n].argmax())
            if label and p[n, label] >= THRESHOLD:
                token = texts[i][a:b].strip("(.,;: ") if label != 4 else texts[i][a:b].rstrip(".,;: ")
                start = a + texts[i][a:b].index(token)
                added[i].append((start, label - 1, start + len(token)))
    return base, added


def field_report(texts: list[str]) -> dict[str, object]:
    """How much the field does on some texts: free nodes, spans added by the whole field, by its chain alone and by no edges, and the marginals of the likeliest kind."""
    base = [base_spans(t) if ANY.search(t) else [] for t in texts]
    field, free = field_of(texts, base)
    nodes = [n for *_, n in free]
    out: dict[str, object] = {"base": sum(map(len, base)), "free": len(free)}
    for name, f in (("added", field), ("added by the chain alone", field.without(1)), ("added without edges", field.without(1).without(0))):
        p = f.marginals(trained())[nodes][:, 1:].max(axis=1) if free else np.zeros(0)
        out[name] = int((p >= THRESHOLD).sum())
        if name == "added":
            out["marginals"] = np.histogram(p, bins=10, range=(0, 1))[0].tolist()
    return out


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])


def find(docs: DataFrame) -> DataFrame:
    """doc_id and its spans (kind, start, end, base) by start, then kind; code points, end exclusive."""

    def scan(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                spans = [
                    [{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in sorted([(*x, True) for x in base] + [(*x, False) for x in added])]
                    for base, added in zip(*find_spans(texts), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(SPAN))], ["doc_id", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(scan), "doc_id long, spans array<struct<kind: string, start: long, end: long, base: boolean>>")


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first one names the whole stretch."""
    out, at = [], 0
    merged: list[list[int]] = []
    for a, k, b in sorted(spans):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([a, k, b])
    for a, k, b in merged:
        out += [text[at:a], f"<{KINDS[k]}>"]
        at = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """The same rows and columns, personal data in ``text`` replaced by <kind>; null texts stay null."""
    at = docs.columns.index("text")

    def scan(batches):
        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                clean = [masked(t, b + a) if b or a else t for t, b, a in zip(texts, *find_spans(texts), strict=True)]
                column = pa.array(clean, part.column(at).type, mask=part.column(at).is_null().to_numpy(zero_copy_only=False))
                yield part.set_column(at, part.schema.field(at), column)

    return docs.mapInArrow(lean(scan), docs.schema)
