"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, a classifier decides.

Spans that fulfil the plain rules (``BASE``) are always reported. Candidates beyond them are spans of other kinds and number runs that the
rules drop. Regex, gazetteer and context labelers vote on every candidate; the votes of all documents are counted by pattern
in Spark. From these counts, expectation-maximisation estimates how reliable each labeler is and how likely each pattern is personal data; a
logistic regression on the patterns, trained on these likelihoods, is the final span classifier.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankcut.llm.frames import release
from rankcut.llm.linear import sigmoid

BASE = ("email", "ip", "card", "phone")
ADDED = ("secret", "iban", "account", "handle")
KINDS = BASE + ADDED
THRESHOLD = 0.5
LABELERS = ("regex", "gazetteer", "before", "frame", "prose")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+={0,2}")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_HANDLE = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\[at\]|\(at\)) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\.) ?[A-Za-z0-9-]{1,63}){1,4}")

# Words that announce personal data, by kind, and the first letters or digits that real ones have.
BEFORE = {
    "secret": {"token", "secret", "key", "apikey", "api_key", "password", "passwort", "passwd", "pwd", "bearer", "auth", "clave", "contraseña"},
    "iban": {"iban", "konto", "kontonummer", "account", "cuenta", "compte"},
    "account": {"card", "karte", "kreditkarte", "visa", "mastercard", "carte", "tarjeta", "account", "konto", "cuenta", "compte"},
    "handle": {"mail", "email", "e-mail", "contact", "kontakt", "correo", "courriel"},
}
SECRET_STARTS = ("AKIA", "ghp_", "gho_", "sk-", "sk_", "xox", "AIza", "eyJ", "glpat-")
IBAN_COUNTRIES = {"AT", "BE", "CH", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GB", "GR", "HR", "HU", "IE", "IT", "LT", "LU", "LV", "MT", "NL", "NO", "PL", "PT", "RO", "SE", "SI", "SK"}
DOMAIN_ENDS = {"com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu"}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, read outwards from each ``@``, so that no run of characters is read again and again."""
    free, at = 0, text.find("@")
    while at >= 0:
        run = text[free:at]
        start = free + len(run.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        free = domain.end() if domain else at + 1
        if domain:
            yield start, domain.end()
        at = text.find("@", free)


def _small(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the plain rules by kind, and under ``account`` the number runs of 13 to 19 digits that fail the checksum."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in (*BASE, "account")}
    found["email"] = list(emails(text))
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19:
            found["card" if luhn(digits) else "account"].append(m.span())
    found["phone"] = [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return found


def _iban_valid(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def votes(text: str, kind: str, start: int, end: int) -> tuple[int, ...]:
    """One vote per labeler: 1 for personal data, -1 against, 0 none."""
    span = text[start:end]
    digits, letters, upper = sum(c.isdigit() for c in span), sum(c.islower() for c in span), sum(c.isupper() for c in span)
    if kind == "secret":
        regex = 1 if digits >= 4 and letters + upper >= 4 and digits + letters + upper >= 0.9 * len(span) else -1
        gazetteer = 1 if span.startswith(SECRET_STARTS) or (len(span) in (32, 40, 64) and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", span)) else 0
    elif kind == "iban":
        regex, gazetteer = (1 if _iban_valid(span) else -1), (1 if span[:2] in IBAN_COUNTRIES else -1)
    elif kind == "account":
        regex, gazetteer = -1, (1 if span[0] in "3456" else -1)
    else:
        regex, gazetteer = 1, (1 if re.split(r"[ .\])]+", span)[-1].lower() in DOMAIN_ENDS else 0)
    left = text[max(0, start - 40) : start]
    before = 1 if BEFORE[kind] & set(re.split(r"[^\w-]+", left.lower())) else 0
    frame = 1 if re.search(r"[=:]\s*[\"']?$", left) or left.endswith(('"', "'")) else 0
    prose = -1 if kind == "secret" and (digits < 4 or re.search(r"[a-z]{9,}", span.lower())) else 0
    return regex, gazetteer, before, frame, prose


def candidates(text: str, base: dict[str, list[tuple[int, int]]]) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """Candidate spans beyond the plain rules, none of which overlaps a reported span or an earlier candidate."""
    taken = sorted(s for k in BASE for s in base[k])
    runs: list[tuple[str, int, int]] = [("account", *s) for s in base["account"]]
    runs += [("secret", *m.span()) for m in _SECRET.finditer(text) if any(c.isdigit() for c in m.group())]
    runs += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    if "at]" in text or "at)" in text:
        runs += [("handle", *m.span()) for m in _HANDLE.finditer(text)]
    out: list[tuple[str, int, int, tuple[int, ...]]] = []
    starts = np.array([s for s, _ in taken], np.int64)
    ends = np.maximum.accumulate(np.array([e for _, e in taken], np.int64)) if taken else starts
    last = -1
    for kind, s, e in sorted(runs, key=lambda r: (r[1], ADDED.index(r[0]))):
        k = int(np.searchsorted(starts, e)) - 1
        if s < last or (k >= 0 and ends[k] > s):
            continue
        out.append((kind, s, e, votes(text, kind, s, e)))
        last = e
    return out


def vote_patterns(documents: DataFrame, text: str = "text") -> DataFrame:
    """``kind, votes, n``: candidates of all documents, counted by kind and vote pattern (at most 3 to the number of labelers per kind)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[tuple, int] = {}
            for value in batch.column(0):
                body = value.as_py()
                if body:
                    for kind, _, _, v in candidates(body, base_spans(body)):
                        counts[kind, v] = counts.get((kind, v), 0) + 1
            keys = list(counts)
            yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in keys], "votes": pa.array([list(v) for _, v in keys], pa.list_(pa.int32())), "n": pa.array([counts[k] for k in keys], pa.int64())},
                                             schema=pa.schema([("kind", pa.string()), ("votes", pa.list_(pa.int32())), ("n", pa.int64())]))
        release()

    counted = documents.select(text).mapInArrow(run, "kind string, votes array<int>, n long")
    return counted.groupBy("kind", "votes").agg(F.sum("n").alias("n"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Likelihood of each vote pattern to be personal data, and each labeler's vote probabilities given the truth.

    Expectation-maximisation for labelers that are independent given the truth, on pattern counts; it starts from the mean vote
    and holds probabilities away from 0 and 1 by one imagined vote of each sort, placed where a sound labeler would put it.
    """
    v = np.array([p for p, _ in patterns]) + 1  # 0 against, 1 none, 2 for
    n = np.array([c for _, c in patterns], float)
    q = sigmoid(2.0 * (v - 1).sum(axis=1))
    prior = np.array([[[3.0, 2.0, 1.0], [1.0, 2.0, 3.0]]])  # truth 0, truth 1
    theta = np.zeros((v.shape[1], 2, 3))
    for _ in range(rounds):
        share = (n @ q + 1) / (n.sum() + 2)
        for labeler in range(v.shape[1]):
            for truth, weight in ((0, 1 - q), (1, q)):
                theta[labeler, truth] = np.bincount(v[:, labeler], n * weight, 3)
        theta += prior
        theta /= theta.sum(axis=2, keepdims=True)
        logs = np.log(theta)
        lift = sum(logs[k, 1, v[:, k]] - logs[k, 0, v[:, k]] for k in range(v.shape[1]))
        q = sigmoid(lift + np.log(share / (1 - share)))
    return q, theta


def fit_classifier(patterns: list[tuple[tuple[int, ...], int]], q: np.ndarray, steps: int = 300, l2: float = 0.01) -> np.ndarray:
    """Logistic regression from one-hot votes (bias first) to the likelihoods, weighted by the logarithm of the pattern's count."""
    x = np.array([_one_hot(p) for p, _ in patterns])
    weight = np.log1p(np.array([c for _, c in patterns], float))
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton's method
        p = sigmoid(x @ w)
        gradient = x.T @ (weight * (p - q)) + l2 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w))
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _one_hot(pattern: tuple[int, ...]) -> list[float]:
    return [1.0] + [float(v == value) for v in pattern for value in (-1, 1)]


def learn(documents: DataFrame, text: str = "text") -> dict[str, np.ndarray]:
    """Weights of the span classifier of each kind. Only pattern counts reach the driver."""
    found: dict[str, list] = {}
    for r in vote_patterns(documents, text).orderBy("kind", "votes").collect():
        found.setdefault(r["kind"], []).append((tuple(r["votes"]), r["n"]))
    return {kind: fit_classifier(p, estimate(p)[0]) for kind, p in found.items()}


def spans_of(text: str, model: dict[str, np.ndarray], threshold: float = THRESHOLD) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Spans of the plain rules, and those the classifier adds."""
    base = base_spans(text)
    plain = [(k, s, e) for k in BASE for s, e in base[k]]
    added = [(kind, s, e) for kind, s, e, v in candidates(text, base) if kind in model and sigmoid(np.array(model[kind] @ _one_hot(v))) >= threshold]
    return plain, sorted(added, key=lambda x: (ADDED.index(x[0]), x[1]))


def _written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(documents: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every whole text; then ``n_added`` and ``n_spans``, the number of all spans.

    Counts and checksum are of the plain rules' spans; ``spans`` has the added ones after them, kind by kind. Positions are code points, ends
    exclusive. Null and empty texts have no spans. Repeated rows each get their result; a null ``doc_id`` stays null. Of candidates that overlap
    each is judged alone. Without any candidate no classifier is trained and nothing is added. Other columns, whatever their names, are ignored.
    An empty table gives no rows.
    """
    model = learn(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(1):
                plain, added = spans_of(value.as_py() or "", model)
                counts = [sum(k == kind for k, _, _ in plain) for kind in BASE]
                rows.append((*counts, hashlib.sha256(_written(plain).encode()).hexdigest(), _written(plain + added), len(added), len(plain) + len(added)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string()), pa.array(cols[5], pa.string()), *[pa.array(c, pa.int64()) for c in cols[6:]]]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans", "n_added", "n_spans"])
        release()

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_spans long")


def redact(documents: DataFrame, text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; overlapping spans are one, named after the first. A null text stays null."""
    model = learn(documents, text)
    columns = documents.columns
    at = columns.index(text)

    def clean(body: str) -> str:
        plain, added = spans_of(body, model)
        parts, done = [], 0
        for kind, s, e in sorted(plain + added, key=lambda x: (x[1], -x[2])):
            if s >= done:
                parts += [body[done:s], f"[{kind.upper()}]"]
            done = max(done, e)
        return "".join([*parts, body[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [v.as_py() for v in batch.column(at)]
            new = pa.array([b if b is None else clean(b) for b in bodies], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=columns)
        release()

    return documents.mapInArrow(run, documents.schema)
