"""Operator 4: personal data by weakly supervised span labelling.

Exact patterns give the base spans.  Looser patterns give further candidates (numbers without
a country code, shorter cards, written-out addresses, long-form IP addresses, matches that failed a
check) and secrets: long mixed runs such as access tokens, which no base pattern describes.  Labelers vote on every candidate: pattern, checksum, gazetteer, context, borders, variety.
Expectation-maximisation over the counts of all vote patterns of all documents estimates how
reliable each labeler is, and from its soft labels a logistic classifier is trained, which decides
about the candidates that are not base spans.  What reaches the driver is one row per pattern of votes,
at most 3 ** 6 for each kind.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlog.llm.text import bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
#: Secrets are only ever added: they have no exact pattern.
KINDS = (*BASE_KINDS, "secret")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "borders", "variety")
CHECKSUM = LABELERS.index("checksum")
#: A candidate that is no base span is added from this probability on, unless it fails its checksum.
SURE = 0.9
#: Characters before and after a candidate that the context labeler reads.
CONTEXT_CHARS = 40

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"\x20?[(\[]\x20?at\x20?[)\]]\x20?", re.IGNORECASE)
_NAME = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_HOST = re.compile(
    r"[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[(\[]\x20?dot\x20?[)\]]\x20?)[A-Za-z0-9-]{1,63}){1,8}",
    re.IGNORECASE,
)
_LOCAL_PHONE = re.compile(r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}")
_LONG_IP = re.compile(r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}")

#: A secret has at least so many characters, a letter and a digit.
SECRET_CHARS = 20
_SECRET = re.compile(r"[A-Za-z0-9_+/-]{%d,}" % SECRET_CHARS)
_ASSIGNED = re.compile(
    r"(?:token|secret|password|passwd|pwd|key|auth|bearer)[\"']?\s?[:=\s]\s?[\"']?\Z", re.IGNORECASE
)
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")

_LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")

# Gazetteers and context words.
_TOP_DOMAINS = frozenset("com org net edu gov info io de fr es it uk eu ch at us ca mx".split())
_CARD_STARTS = ("34", "37", "4", "51", "52", "53", "54", "55", "6011", "65")
_SECRET_STARTS = ("AKIA", "ghp_", "gho_", "sk-", "sk_", "pk_", "xox", "AIza", "eyJ")
_NEAR = {
    "email": "mail email e-mail contact write courriel correo kontakt",
    "ip": "ip host server address login client adresse",
    "card": "card visa credit payment carte tarjeta karte",
    "phone": "phone tel call mobile fax telefon telefono telephone",
    "secret": "token secret password passwd pwd key auth bearer credential credentials login",
}
_NEAR = {kind: frozenset(words.split()) for kind, words in _NEAR.items()}
_AGAINST = frozenset("version isbn issn order invoice serial build sha checksum id".split())


def passes_luhn(digits: str) -> bool:
    total = 0
    for at, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + at % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost matches without overlap.  Every match holds one @ after a run of address
    characters, so each @ is tried once from where that run, or the last match, ends."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LETTERS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        free = at + 1
        if found:
            out.append((start, found.end()))
            free = found.end()
        at = text.find("@", free)
    return out


def _small(part: str) -> bool:
    """At most 255; however many zeros lead, only what is left is made a number."""
    digits = part.lstrip("0")
    return len(digits) < 4 and int(digits or "0") <= 255


def ip_spans(text: str) -> Iterator[tuple[int, int, bool]]:
    """Four numbers joined by dots, leftmost first, and whether all are at most 255."""
    for chain in _CHAIN.finditer(text):
        parts = chain.group().split(".")
        start = chain.start()
        for at in range(0, len(parts) - 3, 4):
            four = parts[at : at + 4]
            end = start + sum(map(len, four)) + 3
            yield start, end, all(_small(p) for p in four)
            start = end + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The exact matches: kinds in order, then by start."""
    out = [("email", *s) for s in email_spans(text)] if "@" in text else []
    if "." in text:
        out += [("ip", a, b) for a, b, valid in ip_spans(text) if valid]
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 16:
            digits = _digits(found.group())
            if 16 <= len(digits) <= 19 and passes_luhn(digits):
                out.append(("card", *found.span()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 8 <= len(_digits(found.group())) <= 15:
                out.append(("phone", *found.span()))
    return out


def candidate_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, bool]]:
    """Base spans, and looser matches that do not touch any of them."""
    taken = np.zeros(0, np.int64)
    if base:
        taken = np.array(sorted((a, b) for _, a, b in base))
    out = [(*s, True) for s in base]

    def loose(kind: str, start: int, end: int) -> None:
        if len(taken):
            behind = int(np.searchsorted(taken[:, 0], end))
            if (taken[:behind, 1] > start).any():
                return
        out.append((kind, start, end, False))

    if "." in text:
        for start, end, valid in ip_spans(text):
            if not valid:
                loose("ip", start, end)
    for found in _CARD.finditer(text):
        if 13 <= found.end() - found.start() and 13 <= len(_digits(found.group())) <= 19:
            loose("card", *found.span())
    for found in _LOCAL_PHONE.finditer(text):
        loose("phone", *found.span())
    if ":" in text:
        for found in _LONG_IP.finditer(text):
            loose("ip", *found.span())
    for found in _AT.finditer(text):
        name = _NAME.search(text, max(0, found.start() - 64), found.start())
        host = _HOST.match(text, found.end())
        if name and host:
            loose("email", name.start(), host.end())
    for found in _SECRET.finditer(text):
        span = found.group()
        if any("0" <= c <= "9" for c in span) and any(c.isalpha() for c in span):
            loose("secret", *found.span())
    return out


def _switches(span: str) -> int:
    """How often digits and other characters take turns: often in random runs, seldom in names."""
    digit = np.frombuffer(span.encode("ascii"), np.uint8)
    digit = (digit >= 48) & (digit <= 57)
    return int((digit[1:] != digit[:-1]).sum())


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """One vote per labeler: 1 for personal data, -1 against, 0 for none."""
    span = text[start:end]
    digits = _digits(span)
    pattern = 1 if base else -1
    if kind == "card":
        checksum = 1 if passes_luhn(digits) else -1
        gazetteer = 1 if digits.startswith(_CARD_STARTS) else -1
    elif kind == "phone":
        checksum = 1 if 8 <= len(digits) <= 15 else -1
        gazetteer = -1 if digits.startswith("0") and not span.startswith("+") else 0
    elif kind == "ip":
        parts = span.split(".")
        checksum = 1 if len(parts) != 4 or all(len(p) < 4 and int(p) <= 255 for p in parts) else -1
        gazetteer = -1 if parts[0] in ("0", "255") else 0
    elif kind == "secret":
        pattern = 1 if _ASSIGNED.search(text, max(0, start - CONTEXT_CHARS), start) else -1
        checksum = 1 if 8 * _switches(span) >= len(span) else -1
        gazetteer = 1 if span.startswith(_SECRET_STARTS) else -1 if _UUID.match(span) else 0
    else:
        checksum = 1 if ".." not in span else -1
        last = re.split(r"[.)\]\x20]+", span)[-1].lower()
        gazetteer = 1 if last in _TOP_DOMAINS else -1
    words = set(
        re.findall(
            r"[a-z-]+",
            (text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS]).lower(),
        )
    )
    context = 1 if words & _NEAR[kind] else -1 if words & _AGAINST else 0
    before, after = text[start - 1 : start], text[end : end + 1]
    borders = -1 if before.isalnum() or after.isalnum() else 1
    variety = -1 if digits and len(set(digits)) < 3 else 1 if len(set(span)) > 5 else 0
    return pattern, checksum, gazetteer, context, borders, variety


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60):
    """Expectation-maximisation over vote patterns: (share of positives, chance of every vote
    in both classes, posterior of every pattern).  Starts from the mean vote; one added row
    per vote keeps chances off zero."""
    posterior = 1 / (1 + np.exp(-2.0 * patterns.sum(axis=1)))
    chance = np.zeros((2, patterns.shape[1], 3))
    share = 0.5
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        share = (weight[1].sum() + 1) / (weight.sum() + 2)
        for vote in (-1, 0, 1):
            chance[:, :, vote + 1] = weight @ (patterns == vote) + 1
        chance /= chance.sum(axis=2, keepdims=True)
        fit = np.log(chance[:, np.arange(patterns.shape[1])[None, :], patterns + 1]).sum(axis=2)
        odds = np.log(share / (1 - share)) + fit[1] - fit[0]
        posterior = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return share, chance, posterior


def span_features(kinds: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """Every vote as for and against, the kind, and a constant."""
    columns = [patterns == 1, patterns == -1]
    columns.append(kinds[:, None] == np.arange(len(KINDS))[None, :])
    columns.append(np.ones((len(kinds), 1), bool))
    return np.hstack(columns).astype(np.float64)


def train_classifier(
    features: np.ndarray, soft: np.ndarray, counts: np.ndarray, steps: int = 25
) -> np.ndarray:
    """Logistic regression on soft labels by Newton steps, lightly held to zero."""
    w = np.zeros(features.shape[1])
    if not len(features):
        return w
    weight = counts / counts.sum() * len(features)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        slope = features.T @ (weight * (p - soft)) + 0.01 * w
        bend = (features * (weight * p * (1 - p))[:, None]).T @ features
        w = w - np.linalg.solve(bend + 0.01 * np.eye(len(w)), slope)
    return w


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    bounded_batches(docs.sparkSession)
    return docs.select(
        F.struct(id_col).alias("row"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """The span classifier's weights, from the candidates of all documents."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: dict[tuple[int, ...], int] = {}  # at most one entry per pattern
        for batch in batches:
            for value in batch.column(0):
                text = value.as_py()
                for kind, start, end, base in candidate_spans(text, base_spans(text)):
                    key = (KINDS.index(kind), *votes(text, kind, start, end, base))
                    tally[key] = tally.get(key, 0) + 1
        rows = np.array([(*k, n) for k, n in tally.items()], np.int64).reshape(-1, len(names) + 1)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in rows.T], names=[*names, "n"])

    names = ["kind", *LABELERS]
    schema = ", ".join(f"{c} long" for c in [*names, "n"])
    counted = _texts(docs, id_col, text_col).select("text").mapInArrow(vote, schema)
    rows = counted.groupBy(*names).agg(F.sum("n").alias("n")).collect()
    table = np.array(sorted(map(tuple, rows)), np.int64).reshape(-1, len(names) + 1)
    kinds, patterns, counts = table[:, 0], table[:, 1:-1], table[:, -1].astype(np.float64)
    if not len(table):
        return np.zeros(span_features(kinds, patterns).shape[1])
    soft = np.zeros(len(table))
    for kind in np.unique(kinds):
        own = kinds == kind
        soft[own] = reliabilities(patterns[own], counts[own])[2]
    return train_classifier(span_features(kinds, patterns), soft, counts)


def find(
    docs: DataFrame, classifier: np.ndarray, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, spans``: an array of (kind, start, end, base, probability), by kind in the order of
    ``KINDS``, then start; places are code points, ``end`` exclusive.

    Base spans are always there; others are added from a probability of ``SURE`` on, never with a
    failed checksum and never touching a base span.  A null text is empty.  Ids play no part, so null and repeated ones are
    answered row by row; other columns are not read; an empty table gives an empty table.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = {kind: at for at, kind in enumerate(KINDS)}
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py()
                spans = candidate_spans(text, base_spans(text))
                if not spans:
                    out.append([])
                    continue
                kinds = np.array([order[s[0]] for s in spans])
                cast = np.array([votes(text, *s) for s in spans])
                sure = 1 / (1 + np.exp(-np.clip(span_features(kinds, cast) @ classifier, -30, 30)))
                kept = [
                    {"kind": k, "start": a, "end": b, "base": base, "probability": float(p)}
                    for (k, a, b, base), v, p in zip(spans, cast, sure, strict=True)
                    if base or (p >= SURE and v[CHECKSUM] >= 0)
                ]
                out.append(sorted(kept, key=lambda s: (order[s["kind"]], s["start"], s["end"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind_of)], names=["row", "spans"])

    kind_of = pa.list_(
        pa.struct(
            [
                ("kind", pa.string()),
                ("start", pa.int64()),
                ("end", pa.int64()),
                ("base", pa.bool_()),
                ("probability", pa.float64()),
            ]
        )
    )
    texts = _texts(docs, id_col, text_col)
    row = texts.schema["row"].dataType.simpleString()
    span = "struct<kind:string,start:bigint,end:bigint,base:boolean,probability:double>"
    done = texts.mapInArrow(label, f"row {row}, spans array<{span}>")
    return done.select(F.col(f"row.`{id_col}`"), "spans")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans, their SHA-256, all spans as kind:start:end, how many they are and
    how many of them the classifier added."""

    def written(spans):
        return F.array_join(
            F.transform(
                spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
            ),
            ",",
        )

    base = F.filter("spans", lambda s: s["base"])
    added = F.filter("spans", lambda s: ~s["base"])

    def count(kind: str):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in BASE_KINDS]
    return found.select(
        id_col,
        *counts,
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        F.size(added).cast("long").alias("n_added"),
    )
