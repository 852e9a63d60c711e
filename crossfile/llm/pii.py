"""Personal data by rules and by weak supervision.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Further candidates, long tokens with a digit,
are voted on by labelers (patterns, a gazetteer, context). Expectation-maximisation over the counts of all vote patterns in
the corpus estimates each labeler's reliability, and a logistic classifier trained on the resulting soft labels decides which
candidates are secrets. Names, birth dates and postal addresses (``persons``) are found the same way, each kind with labelers, reliabilities
and a classifier of its own, and with a gazetteer that can be given as a table. The pattern counts are at most a few thousand rows however large the corpus: every document counts.

Every text is searched whole, by patterns that pass over it once. Null texts are empty. Repeated rows are treated alike; spans that
start together are listed by kind, and a candidate of even odds counts as a secret. Extra
columns are ignored by ``find`` and kept by ``mask``. An empty table, or one without candidates, adds no spans.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crossfile.llm import persons
from crossfile.llm.text import frugal

KINDS = ("email", "ip", "card", "phone", "secret", "account", *persons.FAMILIES)
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TOKEN = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{16,}+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += (n * 2 - 9 if n > 4 else n * 2) if i % 2 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds, by kind and start. Each pass is linear: an email is sought from its @."""
    out: list[tuple[int, int, str]] = []
    at, low = text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            low = m.end()
        else:
            low = at + 1
        at = text.find("@", low)
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


# --- labelers: each votes 1 (secret), -1 (not) or 0 on (token, the text before it) -----------------------------------

_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_ISSUED = re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_(?:live|test)_[A-Za-z0-9]+|xox[abp]_?[A-Za-z0-9]+")
_NAMED = re.compile(r"(?:password|passwd|pwd|secret|token|credential|api[_-]?key|access[_-]?key)s?[\"']?\s*[=:]\s*[\"']?$", re.IGNORECASE)
_ACCOUNT = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{12,30}")
_GIVEN = re.compile(r"[=:]\s*[\"']?$")
#: Starts of tokens: of known secrets, and of known harmless identifiers. Fixed values.
_SECRET_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk_live_", "sk_test_", "xoxa", "xoxb", "xoxp")
_HARMLESS_STARTS = ("http", "www", "isbn", "issn", "doi", "uuid", "version", "chapter", "section")


def _pattern(token: str, before: str) -> int:
    return 1 if _ISSUED.fullmatch(token) else 0


def _hexadecimal(token: str, before: str) -> int:
    if _HEX.fullmatch(token):
        return 1 if any(c.isalpha() for c in token) else -1
    return 0


def _context(token: str, before: str) -> int:
    return 1 if _NAMED.search(before) else 0 if _GIVEN.search(before) else -1


def _gazetteer(token: str, before: str) -> int:
    return 1 if token.startswith(_SECRET_STARTS) else -1 if token.lower().startswith(_HARMLESS_STARTS) else 0


def _entropy(token: str, before: str) -> int:
    n = len(token)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(token).values())
    return 1 if bits >= 3.0 else -1 if bits < 2.5 else 0


def _digits(token: str, before: str) -> int:
    share = sum("0" <= c <= "9" for c in token) / len(token)
    return -1 if share < 0.1 or share > 0.95 else 1 if share >= 0.15 else 0


def is_account(token: str) -> bool:
    """An international bank account number: two letters, two check digits, and the remainder of 97 that these make 1."""
    if not _ACCOUNT.fullmatch(token):
        return False
    return int("".join(str(int(c, 36)) for c in token[4:] + token[:4])) % 97 == 1


def _check_digits(token: str, before: str) -> int:
    return 1 if is_account(token) else 0


LABELERS = (_pattern, _hexadecimal, _context, _gazetteer, _entropy, _digits, _check_digits)


class Model(NamedTuple):
    """Weights of the classifier of every kind that has candidates, and the gazetteer that its labelers voted by."""

    weights: dict[str, np.ndarray]
    terms: persons.Terms


def candidates(text: str) -> list[tuple[int, int, tuple[int, ...]]]:
    """(start, end, features): the votes, and a step of the token's length."""
    out = []
    for m in TOKEN.finditer(text):
        token = m.group()
        if any("0" <= c <= "9" for c in token):
            before = text[max(0, m.start() - 32) : m.start()]
            out.append((m.start(), m.end(), (*(f(token, before) for f in LABELERS), min(3, len(token) // 16))))
    return out


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, voters: int = len(LABELERS), background: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns with counts: (share of personal ones, P(vote | class) by labeler, posterior by pattern). ``background``
    marks patterns that are known not to be personal; where it is given, every other candidate counts half by what labelers right
    nine times out of ten would say of it, and votes are smoothed towards their shares: kinds that are rare would die out otherwise."""
    votes = np.array([p[:voters] for p, _ in patterns]) + 1
    n = np.array([c for _, c in patterns], dtype=float)
    known = np.zeros(len(n), dtype=bool) if background is None else background
    said = (votes - 1).sum(axis=1)
    post, belief = (np.where(known, 0.0, 1 / (1 + np.exp(-np.clip(said * k, -500, 500)))) for k in (1.0, math.log(9)))
    for _ in range(rounds):
        if background is not None:
            post = (post + belief) / 2
        share = float(np.clip((n * post).sum() / n.sum(), 1e-6, 1 - 1e-6))
        table = np.empty((voters, 2, 3))
        for j in range(voters):
            for z, weight in enumerate((n * (1 - post), n * post)):
                counts = np.bincount(votes[:, j], weight, 3) + (0.5 if background is None else 1.5 * np.bincount(votes[:, j], n, 3) / n.sum())
                table[j, z] = counts / counts.sum()
            # Labelers are better than chance, or say nothing: where a vote for would speak against, or one against for, it is of
            # equal weight in both classes.
            for v, sign in ((0, -1), (2, 1)):
                if sign * (table[j, 1, v] - table[j, 0, v]) < 0:
                    table[j, :, v] = share * table[j, 1, v] + (1 - share) * table[j, 0, v]
            table[j] /= table[j].sum(axis=1, keepdims=True)
        odds = math.log(share / (1 - share)) + sum(np.log(table[j, 1, votes[:, j]] / table[j, 0, votes[:, j]]) for j in range(voters))
        post = np.where(known, 0.0, 1 / (1 + np.exp(-np.clip(odds, -500, 500))))
    return share, table, post


def _one_hot(features: tuple[int, ...]) -> list[float]:
    *votes, length = features
    return [1.0, *(float(v == x) for v in votes for x in (-1, 1)), *(float(length == x) for x in (1, 2, 3))]


def train(patterns: list[tuple[tuple[int, ...], int]], steps: int = 300, kind: str = "secret") -> np.ndarray | None:
    """Weights of the final classifier, by Newton-like ascent on the soft labels of all candidates."""
    if not patterns:
        return None
    patterns = sorted(patterns)
    voters = persons.VOTERS.get(kind, len(LABELERS))
    background = np.array([not persons.anchored(kind, p) for p, _ in patterns]) if kind in persons.ANCHORS else None
    _, _, post = reliabilities(patterns, voters=voters, background=background)
    x = np.array([_one_hot(p) for p, _ in patterns])
    n = np.array([c for _, c in patterns], dtype=float)
    if background is not None and 0 < n[~background].sum() < n[background].sum():
        n[background] *= n[~background].sum() / n[background].sum()  # however much ordinary text there is, it weighs no more than candidates
    n /= n.sum()
    # Weights are drawn to one a vote, so that votes never seen together in the corpus still count.
    start = np.array([0.0, *[-1.0, 1.0] * voters, 0.0, 0.0, 0.0])
    w = start.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (n * np.maximum(p * (1 - p), 1e-3))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (n * (post - p)) - 1e-3 * (w - start))
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w


def accepted(kind: str, features: tuple[int, ...], model: Model | None) -> bool:
    """Whether the classifier of the kind takes a candidate for personal; even odds are enough."""
    return model is not None and kind in model.weights and float(np.dot(_one_hot(features), model.weights[kind])) >= 0


def fit(docs: DataFrame, text: str = "text", gazetteer: DataFrame | None = None) -> Model | None:
    """The classifiers, from the candidates of every document; None if there are none. ``gazetteer``: see ``persons.load``."""
    terms = persons.DEFAULTS if gazetteer is None else persons.load(gazetteer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[tuple[str, tuple[int, ...]]] = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    found.update(("secret", f) for _, _, f in candidates(t))
                    for kind, family in persons.FAMILIES.items():
                        found.update((kind, (*v, 0)) for _, _, v in family(t, terms))
        columns = [pa.array([k for k, _ in found], pa.string()), pa.array([",".join(map(str, f)) for _, f in found], pa.string()), pa.array(list(found.values()), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["kind", "f", "n"])

    rows = docs.select(text).mapInArrow(run, "kind string, f string, n long").groupBy("kind", "f").agg(F.sum("n").alias("n")).collect()  # one row per pattern
    patterns: dict[str, list[tuple[tuple[int, ...], int]]] = {}
    for r in rows:
        patterns.setdefault(r.kind, []).append((tuple(map(int, r.f.split(","))), r.n))
    if not patterns:
        return None
    return Model({k: train(p, kind=k) for k, p in patterns.items()}, terms)


def all_spans(text: str, model: Model | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, all spans), each by start and then kind."""
    order = lambda s: (s[0], KINDS.index(s[2]))
    base = base_spans(text)
    taken = sorted(base)
    more = [(a, b, "account" if is_account(text[a:b]) else "secret") for a, b, f in candidates(text) if accepted("secret", f, model)]
    if model is not None:
        for kind, family in persons.FAMILIES.items():
            more += [(a, b, kind) for a, b, v in family(text, model.terms) if persons.anchored(kind, v) and accepted(kind, (*v, 0), model)]
    starts = [x for x, _, _ in taken]
    furthest = list(itertools.accumulate((y for _, y, _ in taken), max))
    # Added spans don't overlap base ones: of these, only those that start before an added one's end can reach into it.
    more = [s for s in more if not (i := bisect.bisect_left(starts, s[1])) or furthest[i - 1] <= s[0]]
    return sorted(base, key=order), sorted(base + more, key=order)


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans and the number of added ones, of every row."""
    docs = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, added = [], [], [], []
            for t in b.column(1).to_pylist():
                base, every = all_spans(t or "", model)
                n = Counter(k for _, _, k in base)
                counts.append([n[k] for k in KINDS[:4]])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                spans.append(_joined(every))
                added.append(len(every) - len(base))
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], [key, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.mapInArrow(frugal(run), f"`{key}` {docs.schema[0].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def masked(text: str, model: Model | None) -> str:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first named stays."""
    out, at = [], 0
    for a, b, kind in all_spans(text, model)[1]:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with personal data masked in its texts; null texts stay null."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if t is None else masked(t, model) for t in b.column(at).to_pylist()], b.schema[at].type)
            yield b.set_column(at, b.schema.field(at), new)

    return docs.mapInArrow(frugal(run), docs.schema)
