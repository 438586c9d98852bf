"""Personal data by weak supervision.

Patterns give base spans, which always stay, and further candidates that patterns alone cannot settle. Labelers vote on
each candidate: the strict pattern, its structure (checksums, ranges, lengths), a gazetteer of what such values start
or end with, the words before it, and its borders. Expectation-maximisation over the votes estimates how far each
labeler can be relied on and how likely each candidate is personal data. These probabilities train a classifier of
spans, which sees the votes and the span's shape, and decides which candidates join the base spans.

Base spans anchor the estimation: they are personal data, so the strict pattern has no vote in it, and what the other
labelers say of base spans tells how reliable they are. Kinds with few spans, or without base spans, borrow from all
kinds together: the votes of all kinds give each labeler's prior, and the classifier of all kinds is where that of a
kind starts. A value's structure can never speak against its own direction.

Candidates are written addresses ("name at host dot com"), numeric addresses with spelt or bracketed dots, card numbers
with other marks between their digits, phone numbers in national form, and tokens of mixed letters and digits. None has
an upper length.

Texts are read once. Votes and shape of a span are one small number, so the driver sees at most one count for each
kind and number, and no text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kartotek.llm import common
from kartotek.sizing import pinned

# Kinds in their order, gazetteers, words before a span
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
GAZETTEER = {
    "email": ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "it", "uk", "eu", "info"),
    "ip": ("10.", "127.", "169.254.", "172.", "192.168.", "8.8."),
    "card": ("34", "36", "37", "38", "4", "51", "52", "53", "54", "55", "6011", "62", "65"),
    "phone": ("+1", "+33", "+34", "+39", "+44", "+49", "001", "0033", "0034", "0044", "0049"),
    "secret": ("sk_", "pk_", "AKIA", "ghp_", "xox", "AIza", "eyJ"),
}
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "from", "to", "cc"),
    "ip": ("ip", "host", "address", "server", "client", "login"),
    "card": ("card", "visa", "mastercard", "amex", "credit", "debit", "account", "pan"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax", "cell", "number"),
    "secret": ("token", "key", "secret", "password", "passwd", "apikey", "api_key", "bearer", "pwd"),
}
AGAINST = ("version", "isbn", "page", "pages", "chapter", "section", "issue", "build", "order", "id", "v", "no", "rfc")

VOTES = 5
SHAPES = 4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOT = r"(?: ?[\[(]?\bdot\b[\])]? ?|\[\.\]|\(\.\))"
_SPELT = re.compile(
    r"(?<![\w.%+-])[A-Za-z0-9._%+-]{2,}+ ?[\[(]?\bat\b[\])]? ?[A-Za-z0-9-]{2,}+(?:" + _DOT + r"[A-Za-z0-9-]{2,}+)+(?!\w)"
)
_SPELT_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?: \. |" + _DOT + r")[0-9]{1,3}){3}(?![0-9])")
_OTHER_CARD = re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{2,6}){2,4}(?![0-9])")
_LOCAL_PHONE = re.compile(r"(?<![\w+])(?:00[0-9]{1,3}[ .-])?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?!\w)")
_TRUNK_PHONE = re.compile(r"(?<![\w+(.,/-])\(?0[1-9][0-9]{0,3}+\)?+(?:[ ./-][0-9]{2,}+)+(?![\w])")
_DATE = re.compile(r"[0-9]{2}[./-][0-9]{2}[./-](?:19|20)[0-9]{2}")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+")
_DIGITS = re.compile(r"[0-9]")
_WORD = re.compile(r"[\w-]+")
_NUMBER = re.compile(r"[0-9]+")
_DOT_WORD = re.compile(r"\bdot\b")

_FOUND = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("spans", pa.list_(pa.struct([
            ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("code", pa.int32()),
        ]))),
    ]
)
_FOUND_SQL = "doc_id long, spans array<struct<kind int, start int, end int, base boolean, code int>>"


def luhn(digits: str) -> bool:
    doubled = [int(d) for d in reversed(digits)]
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(doubled)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches around each @, so that long runs without one cost nothing."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _EMAIL.match(text, start) if start < at else None
        if found:
            yield found.span()
            end = found.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, kind and end of all base spans, in order."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        if "." in text:
            for m in _IP.finditer(text):
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                    out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = _digits(m[0]) if m.end() - m.start() >= 12 else ""
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Start, kind and end of spans that may be personal data and overlap no base span."""
    out = []
    if "dot" in text or "[.]" in text or "(.)" in text:
        out += [(m.start(), 0, m.end()) for m in _SPELT.finditer(text)]
        out += [(m.start(), 1, m.end()) for m in _SPELT_IP.finditer(text)]
    elif " . " in text:
        out += [(m.start(), 1, m.end()) for m in _SPELT_IP.finditer(text)]
    if _DIGITS.search(text):
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(digits := _digits(m[0])) <= 19 and not luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _OTHER_CARD.finditer(text):
            if 13 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _LOCAL_PHONE.finditer(text)]
        for m in _TRUNK_PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 13 and not _DATE.match(m[0]):
                out.append((m.start(), 3, m.end()))
        out += [(m.start(), 4, m.end()) for m in _SECRET.finditer(text)]
    return sorted(s for s in set(out) if not _overlaps(s, base))


def _overlaps(span: tuple[int, int, int], ordered: list[tuple[int, int, int]]) -> bool:
    """Whether a span meets one of the spans ordered by start, of which only those of other kinds overlap."""
    near = bisect_left(ordered, (span[2],))
    return any(end > span[0] for _, _, end in ordered[max(0, near - len(BASE_KINDS)) : near])


def _structure(kind: int, span: str) -> int:
    """Whether the value could be one of its kind: 1, -1, or 0 where its form says nothing."""
    digits = _digits(span)
    if kind == 0:
        host = span.rpartition("@")[2]
        return 1 if ("." in host or _DOT_WORD.search(host)) and span[-1].isalpha() else -1
    if kind == 1:
        parts = _NUMBER.findall(span)
        return -1 if span.startswith("0") or any(len(p) > 3 or int(p) > 255 for p in parts) else 1
    if kind == 2:
        return 1 if luhn(digits) and len(set(digits)) > 2 else -1
    if kind == 3:
        return 1 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else -1
    if len(set(span.lower())) >= 10 and len(digits) * 5 >= len(span):
        return 1
    return 0 if span.startswith(GAZETTEER["secret"]) else -1


def _words_before(text: str, start: int) -> list[str]:
    """The last three words before a place, in lower case, however long they are."""
    reach = 40
    while True:
        low = max(0, start - reach)
        found = [m for m in _WORD.finditer(text, low, start)]
        if low == 0 or len(found) > 3:
            return [m[0].lower() for m in found[-3:]]
        reach *= 4


def votes(text: str, start: int, kind: int, end: int, base: bool) -> list[int]:
    """One vote a labeler: 1 for, -1 against, 0 for none."""
    span, name = text[start:end], KINDS[kind]
    if name == "email":
        known = span.lower().endswith(GAZETTEER[name])
    else:
        known = span.lstrip("(").startswith(GAZETTEER[name])
    before = _words_before(text, start)
    context = 1 if any(w in CONTEXT[name] for w in before) else -1 if before and before[-1] in AGAINST else 0
    joined = (start > 0 and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum())
    return [1 if base else 0, _structure(kind, span), 1 if known else 0, context, -1 if joined else 1]


def shape(text: str, start: int, end: int) -> list[int]:
    """Binary marks of a span's form, for the classifier."""
    span = text[start:end]
    quoted = start > 0 and end < len(text) and text[start - 1] in "\"'`" and text[end] in "\"'`"
    return [int(quoted), int(" " in span or "-" in span), int(len(span) >= 20), int(len(_digits(span)) * 2 > len(span))]


def code_of(vote: list[int], form: list[int]) -> int:
    code = 0
    for v in vote:
        code = code * 3 + v + 1
    for f in form:
        code = code * 2 + f
    return code


def votes_and_shape(code: int) -> tuple[list[int], list[int]]:
    form, vote = [], []
    for _ in range(SHAPES):
        form.append(code & 1)
        code >>= 1
    for _ in range(VOTES):
        vote.append(code % 3 - 1)
        code //= 3
    return vote[::-1], form[::-1]


def _spans_of(text: str) -> list[dict]:
    base = base_spans(text)
    spans = [(*s, True) for s in base] + [(*s, False) for s in candidates(text, base)]
    return [
        {
            "kind": kind, "start": start, "end": end, "base": base,
            "code": code_of(votes(text, start, kind, end, base), shape(text, start, end)),
        }
        for start, kind, end, base in spans
    ]


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_spans_of(t.decode()) for t in common.texts(batch)]
        yield common.batch_of(_FOUND, (batch.column("doc_id"), spans))


def reliabilities(
    patterns: np.ndarray, weights: np.ndarray, rounds: int = 100, anchored: np.ndarray | None = None,
    prior: np.ndarray | None = None, structure: int | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation over vote patterns (rows of -1, 0, 1) with their numbers.

    Gives the probability that a pattern's spans are personal data, and for each class and labeler the probability
    of each vote. Starts from the balance of votes; ``prior`` votes of each sort for either class (one, unless given)
    keep it from zero. ``anchored`` patterns are known to be personal data. The labeler ``structure`` may not be read
    against its direction: its vote against is at least as likely, and its vote for at most as likely, without personal data.
    """
    kinds = patterns + 1
    known = np.zeros(len(patterns), dtype=bool) if anchored is None else anchored
    posterior = np.where(known, 1.0, 1.0 / (1.0 + np.exp(-patterns.sum(axis=1, dtype=float))))
    held = np.ones((2, patterns.shape[1], 3)) if prior is None else prior
    chance = held.copy()
    for _ in range(rounds):
        classes = np.stack([weights * (1 - posterior), weights * posterior])
        for j in range(patterns.shape[1]):
            for v in range(3):
                chance[:, j, v] = classes[:, kinds[:, j] == v].sum(axis=1) + held[:, j, v]
        chance /= chance.sum(axis=2, keepdims=True)
        scores = np.log(chance)
        if structure is not None:
            scores[0, structure, 0] = max(scores[0, structure, 0], scores[1, structure, 0])
            scores[0, structure, 2] = min(scores[0, structure, 2], scores[1, structure, 2])
        # The share of personal data among spans that are not known to be so
        open_ = np.stack([c[~known].sum() for c in classes])
        share = (open_ + 1.0) / (open_.sum() + 2.0)
        logs = np.log(share)[:, None] + sum(scores[:, j, :][:, kinds[:, j]] for j in range(patterns.shape[1]))
        new = np.where(known, 1.0, 1.0 / (1.0 + np.exp(np.clip(logs[0] - logs[1], -500, 500))))
        if np.abs(new - posterior).max(initial=0.0) < 1e-9:
            return new, chance
        posterior = new
    return posterior, chance


def span_classifier(
    design: np.ndarray, soft: np.ndarray, weights: np.ndarray, rounds: int = 50, centre: np.ndarray | None = None
) -> np.ndarray:
    """Logistic regression on soft labels with counts, by Newton steps under a ridge towards ``centre``; bias first."""
    x = np.column_stack([np.ones(len(design)), design])
    centre = np.zeros(x.shape[1]) if centre is None else centre
    beta, ridge = centre.copy(), np.eye(x.shape[1])
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (weights * (soft - p)) - ridge @ (beta - centre)
        step = np.linalg.solve((x * (weights * p * (1 - p))[:, None]).T @ x + ridge, gradient)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


PRIOR_VOTES = 12.0


def accepted_codes(counts: list[tuple[int, int, int]]) -> set[tuple[int, int]]:
    """The (kind, code) of spans that the classifier takes for personal data, from (kind, code, count).

    A candidate whose structure speaks against it (a failing checksum, an impossible part) is never taken. What all kinds
    say counts as ``PRIOR_VOTES`` spans in each kind, and as many as a kind has where none of its spans is a base span.
    """
    rows = sorted(counts)
    if not rows:
        return set()
    both = [votes_and_shape(code) for _, code, _ in rows]
    vote, form = np.array([b[0] for b in both]), np.array([b[1] for b in both])
    weights, kinds = np.array([n for *_, n in rows], dtype=float), np.array([k for k, *_ in rows])
    # Each kind weighs the same in what all kinds say together
    shares = np.array([weights[kinds == k].sum() for k in kinds])
    level = weights * len(weights) / (shares * len(set(kinds.tolist())))
    known, said = vote[:, 0] == 1, vote[:, 1:]
    soft, chance = reliabilities(said, level, anchored=known, structure=0)
    design = np.column_stack([said == 1, said == -1, form]).astype(float)
    centre = span_classifier(design, soft, level)
    out = set()
    for kind in sorted(set(kinds.tolist())):
        at = kinds == kind
        prior = chance * (PRIOR_VOTES if known[at].any() else max(PRIOR_VOTES, weights[at].sum()))
        own, _ = reliabilities(said[at], weights[at], anchored=known[at], prior=prior, structure=0)
        beta = span_classifier(design[at], own, weights[at], centre=centre)
        likely = (beta[0] + design[at] @ beta[1:] > 0) & (said[at][:, 0] >= 0)
        out |= {(kind, code) for (_, code, _), yes in zip([r for r, a in zip(rows, at) if a], likely) if yes}
    return out


def joined(spans: list[dict], accepted: set[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Base spans and the accepted candidates, of those that overlap the first, as (start, kind, end) in order."""
    taken = sorted((s["start"], s["kind"], s["end"]) for s in spans if s["base"])
    more = sorted(
        (s["start"], s["kind"], s["end"]) for s in spans if not s["base"] and (s["kind"], s["code"]) in accepted
    )
    end = 0
    for a, kind, b in more:
        if a >= end:
            taken.append((a, kind, b))
            end = b
    return sorted(taken)


def written(spans) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def _decide(accepted: set[tuple[int, int]]):
    names = [f"n_{k}" for k in BASE_KINDS]
    schema = pa.schema(
        [("doc_id", pa.int64()), *((n, pa.int64()) for n in names), ("base_sha256", pa.string()), ("spans", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list] = [[] for _ in range(len(names) + 2)]
            for spans in batch.column("spans").to_pylist():
                base = sorted((s["start"], s["kind"], s["end"]) for s in spans if s["base"])
                for i in range(len(names)):
                    columns[i].append(sum(kind == i for _, kind, _ in base))
                columns[-2].append(sha256(written(base).encode()).hexdigest())
                columns[-1].append(written(joined(spans, accepted)))
            yield common.batch_of(schema, (batch.column("doc_id"), *columns))

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document doc_id, the number of base spans of each kind, their SHA-256, and all spans as text.

    Places count code points, ends are exclusive. Null and empty texts have no spans; rows that repeat an id are rows
    of their own. A kind without spans has no classifier and no added spans. No rows give no rows.
    """
    found = pinned(common.id_and_text(docs, id_col, text_col).mapInArrow(_find, _FOUND_SQL))
    span = found.select(F.explode("spans").alias("s"))
    counts = [tuple(r) for r in span.groupBy("s.kind", "s.code").agg(F.count(F.lit(1)).alias("n")).collect()]
    numbers = ", ".join(f"n_{k} long" for k in BASE_KINDS)
    return found.mapInArrow(
        _decide(accepted_codes(counts)), f"doc_id long, {numbers}, base_sha256 string, spans string"
    )


def _redact(mask: str):
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(common.texts(batch), batch.column("spans").to_pylist()):
                plain, pieces, at = text.decode(), [], 0
                for item in filter(None, (spans or "").split(",")):
                    kind, start, end = item.split(":")
                    if int(end) > at:
                        pieces += [plain[at : max(at, int(start))], mask.format(kind=kind.upper())]
                        at = int(end)
                out.append("".join(pieces) + plain[at:])
            yield common.batch_of(schema, (batch.column("doc_id"), out))

    return run


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<{kind}>") -> DataFrame:
    """doc_id and text with every span replaced by a mask; rows that share an id need equal texts."""
    spans = find(docs, id_col, text_col).select(F.col("doc_id").alias("__doc"), "spans").dropDuplicates(["__doc"])
    rows = common.id_and_text(docs, id_col, text_col).join(spans, F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    return rows.drop("__doc").mapInArrow(_redact(mask), "doc_id long, text string")
