"""PII: base patterns, and further spans that weakly supervised labelers vote for.

Every token with a digit that no base span covers is a candidate. A pattern, a gazetteer, a context and a shape
labeler vote on it (1, 0, or -1 to abstain). The votes of all candidates of the corpus are counted by pattern of
votes; expectation-maximisation over these counts estimates each labeler's reliability and each pattern's probability;
a logistic span classifier is trained on the candidates' features against these probabilities and decides.

Contract on edge cases: a null or empty text has no spans; a null id passes through; repeated rows are judged one by
one; an empty table gives an empty result, and a corpus without candidates a classifier that adds nothing; other
columns are ignored, whatever their names. A very long text takes time in proportion to its length, and memory for its
spans. Ties: of overlapping candidates the grouped telephone number wins, then the earlier one; a probability of exactly
the threshold counts as personal data.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import logistic, materialize, texts

BASE_KINDS = ("email", "ip", "card", "phone")
#: Order of kinds in a list of spans: the base kinds, then those that only the method adds.
KINDS = (*BASE_KINDS, "iban", "secret", "ssn")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile(r"[0-9]")
#: A match takes whole runs of digits, so it can start only where a run starts.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
#: A maximal run of 16 digits or more is the same with or without the lower bound.
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9]){15,}")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A telephone number in a common grouping. The base pattern takes digits that follow for a part of it, and then fails as a whole.
GROUPED = re.compile(r"\+[0-9]{1,3}[\x20.-]?\(?[0-9]{2,4}\)?[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])")
TOKEN = re.compile(r"(?<!\S)[^\s0-9]*[0-9]\S*")
LEFT, RIGHT = "\"'([{<`", ".,;:!?)]}>\"'`"
NOT_DIGIT = re.compile(r"[^0-9]")

#: Fixed words of the gazetteer labeler.
SECRET_WORDS = frozenset("password passwd pwd passphrase secret token key apikey api_key credential credentials ssn iban passport account pin cvv".split())
PLAIN_WORDS = frozenset("version license licence licensed copyright chapter page section article part figure table year vol no cc by-nc by-sa gpl isbn rfc public".split())
KNOWN = (("ssn", re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")), ("iban", re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")), ("secret", re.compile(r"A[KS]IA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|sk-[A-Za-z0-9_-]{20,}|(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{16,}")))
PLAIN = re.compile(r"[0-9]{1,6}|[0-9]{1,3}(?:[.,:/-][0-9]{1,4}){1,3}|[0-9]+[a-z]{1,2}")
SWITCH = re.compile(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")
WORD = re.compile(r"[A-Za-z_-]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of kind, start, end) by kind, then start."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if not DIGIT.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if 16 <= len(d := NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= len(NOT_DIGIT.sub("", m[0])) <= 15]
    return out


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, str, tuple[int, ...], tuple[int, ...]]]:
    """(start, end, kind, votes, features) of each grouped telephone number and each token with a digit that overlap no base span and no other candidate."""
    if not DIGIT.search(text):
        return []
    taken = sorted((s, e) for _, s, e in base)
    out, at, reach = [], 0, 0
    if "+" in text:
        ends = list(accumulate((e for _, e in taken), max))  # the furthest end of the spans up to each: kinds can overlap
        grouped = [m.span() for m in GROUPED.finditer(text)]
        grouped = [(s, e) for s, e in grouped if not (k := bisect_left(taken, (e,))) or ends[k - 1] <= s]
        out = [(s, e, *judge(text[s:e], "", text[max(0, s - 24) : s], False, False, "phone")) for s, e in grouped]
        taken = sorted(taken + grouped)
    for m in TOKEN.finditer(text):
        start, end = m.span()
        while at < len(taken) and taken[at][0] < end:
            reach, at = max(reach, taken[at][1]), at + 1
        if reach > start:
            continue
        token = m[0]
        cut = max(token.find("="), token.find(":"))
        key = token[:cut].lower() if cut > 0 else ""
        body = token[cut + 1 :] if cut > 0 else token
        quoted = body[:1] in LEFT and body[:1] != ""
        start += len(token) - len(body)
        trimmed = body.lstrip(LEFT)
        start += len(body) - len(trimmed)
        trimmed = trimmed.rstrip(RIGHT)
        if not DIGIT.search(trimmed):
            continue
        before = text[max(0, m.start() - 24) : m.start()]
        out.append((start, start + len(trimmed), *judge(trimmed, key, before, quoted, cut > 0)))
    return out


def judge(token: str, key: str, before: str, quoted: bool, assigned: bool, kind: str = "") -> tuple[str, tuple[int, ...], tuple[int, ...]]:
    kind = kind or next((k for k, p in KNOWN if p.fullmatch(token)), "")
    if not kind and 13 <= len(token) <= 19 and token.isascii() and token.isdigit() and luhn(token):
        kind = "card"
    pattern = 1 if kind else 0 if PLAIN.fullmatch(token) else -1
    near = WORD.findall(f"{before} {key}".lower())[-3:]
    named = any(w in SECRET_WORDS for w in near)
    gazetteer = 1 if named else 0 if any(w in PLAIN_WORDS for w in near) else -1
    assigned = assigned or before.rstrip()[-1:] in ("=", ":")
    context = 1 if assigned and (quoted or named) else 0 if not assigned and not quoted else -1
    switches, digits = len(SWITCH.findall(token)), len(NOT_DIGIT.sub("", token))
    shape = 1 if (switches >= 3 and len(token) >= 12) or kind in BASE_KINDS else 0 if len(token) < 8 or digits == len(token) else -1
    features = (min(len(token) // 4, 6), min(4 * digits // len(token), 3), min(switches, 4), int(token != token.lower()), int(assigned), int(quoted), int(named), int(bool(kind)))
    return kind or "secret", (pattern, gazetteer, context, shape), features


WIDTHS = (7, 4, 5, 2, 2, 2, 2, 2)


def one_hot(features: np.ndarray) -> np.ndarray:
    x = np.zeros((len(features), sum(WIDTHS) + 1))
    offset = np.concatenate([[0], np.cumsum(WIDTHS)[:-1]])
    np.put_along_axis(x, features + offset, 1.0, axis=1)
    x[:, -1] = 1.0
    return x


class SpanModel:
    """Reliabilities of the labelers and the span classifier, fitted on counts of (votes, features)."""

    def __init__(self):
        self.weight = np.zeros(sum(WIDTHS) + 1)
        self.weight[-1] = -30.0
        self.reliability = np.zeros((4, 2))

    def fit(self, votes: np.ndarray, features: np.ndarray, counts: np.ndarray, rounds: int = 50) -> SpanModel:
        if not len(counts):
            return self
        cast = votes >= 0
        p = np.where(cast.any(axis=1), (np.where(cast, votes, 0).sum(axis=1) + 0.5) / (cast.sum(axis=1) + 1.0), 0.3)
        for _ in range(rounds):  # EM: share of positives, and how often each labeler that votes is right in each class
            share = np.clip((counts * p).sum() / counts.sum(), 0.01, 0.99)
            rate = np.empty((votes.shape[1], 2))
            for c, q in enumerate((1 - p, p)):
                w = (counts * q)[:, None] * cast
                rate[:, c] = ((w * (votes == c)).sum(axis=0) + 4.0) / (w.sum(axis=0) + 5.0)  # a labeler is held to be right more often than not
            odds = np.log(share / (1 - share)) * np.ones(len(counts))
            for k in range(votes.shape[1]):
                odds += np.where(votes[:, k] == 1, np.log(rate[k, 1] / (1 - rate[k, 0])), 0.0) + np.where(votes[:, k] == 0, np.log((1 - rate[k, 1]) / rate[k, 0]), 0.0)
            p = logistic(odds)
        self.reliability = rate
        x = one_hot(features)
        weight = np.zeros(x.shape[1])
        scale = counts / counts.sum()
        for _ in range(30):  # Newton's method on the ridge logistic loss against soft targets
            q = logistic(x @ weight)
            grad = x.T @ (scale * (q - p)) + 1e-4 * weight
            hess = (x * (scale * q * (1 - q))[:, None]).T @ x + 1e-4 * np.eye(x.shape[1])
            weight -= np.clip(np.linalg.solve(hess, grad), -2, 2)
        self.weight = weight
        return self

    def probability(self, features: np.ndarray) -> np.ndarray:
        return logistic(one_hot(features) @ self.weight) if len(features) else np.zeros(0)

    def accepted(self, threshold: float) -> np.ndarray:
        """For each encoded combination of features, of which there are few: does it count as personal data?"""
        return self.probability(np.stack(np.unravel_index(np.arange(np.prod(WIDTHS)), WIDTHS), axis=1)) >= threshold


def encode(values: tuple[int, ...], widths: tuple[int, ...], shift: int = 0) -> int:
    n = 0
    for v, w in zip(values, widths, strict=True):
        n = n * w + v + shift
    return n


def decode(n: int, widths: tuple[int, ...], shift: int = 0) -> tuple[int, ...]:
    out = []
    for w in reversed(widths):
        n, v = divmod(n, w)
        out.append(v - shift)
    return tuple(reversed(out))


VOTE_WIDTHS = (3, 3, 3, 3)


def fit_counts(rows: DataFrame) -> SpanModel:
    """rows: votes, features (both as numbers), n. Their kinds are bounded by the labelers and the bins, whatever the corpus."""
    got = rows.groupBy("votes", "features").agg(F.sum("n").alias("n")).toPandas().sort_values(["votes", "features"])
    votes = np.array([decode(v, VOTE_WIDTHS, 1) for v in got["votes"]], dtype=np.int64).reshape(-1, 4)
    features = np.array([decode(f, WIDTHS) for f in got["features"]], dtype=np.int64).reshape(-1, len(WIDTHS))
    return SpanModel().fit(votes, features, got["n"].to_numpy(dtype=np.float64))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans: base and candidate spans of each text (kind, start, end, votes, features; both -1 for base spans)."""
    kind = docs.schema[id_col].dataType.simpleString()
    fields = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("votes", pa.int32()), ("features", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in texts(batch.column(1)):
                base = base_spans(text)
                spans = [(BASE_KINDS[k], s, e, -1, -1) for k, s, e in base]
                out.append(spans + [(k, s, e, encode(v, VOTE_WIDTHS, 1), encode(f, WIDTHS)) for s, e, k, v, f in candidates(text, base)])
            flat = [x for spans in out for x in spans]
            columns = [pa.array([x[i] for x in flat], type=f.type) for i, f in enumerate(fields)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(s) for s in out])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(columns, fields=list(fields)))], names=[id_col, "spans"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, spans array<struct<kind: string, start: bigint, end: bigint, votes: int, features: int>>")


def vote_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of (votes, features) over all candidates, summed within each batch first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally = Counter()
            for text in texts(batch.column(0)):
                tally.update((encode(v, VOTE_WIDTHS, 1), encode(f, WIDTHS)) for _, _, _, v, f in candidates(text, base_spans(text)))
            keys = list(tally)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], type=pa.int32()), pa.array([k[1] for k in keys], type=pa.int32()), pa.array([tally[k] for k in keys], type=pa.int64())], names=["votes", "features", "n"])

    return docs.select(text_col).mapInArrow(scan, "votes int, features int, n bigint")


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """id, n_<kind> of each base kind, base_sha256, spans (all spans as kind:start:end, by kind in the order of KINDS, then start)."""
    found = materialize(find(docs, id_col, text_col), "pii-spans")
    one = F.explode("spans").alias("s")
    accepted = fit_counts(found.select(one).where("s.votes >= 0").groupBy("s.votes", "s.features").agg(F.count(F.lit(1)).alias("n"))).accepted(threshold)
    kind = docs.schema[id_col].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, hashes, all_spans = np.zeros((len(BASE_KINDS), batch.num_rows), dtype=np.int64), [], []
            for i, spans in enumerate(batch.column(1).to_pylist()):
                base = [(s["kind"], s["start"], s["end"]) for s in spans if s["votes"] < 0]
                for k, _, _ in base:
                    counts[BASE_KINDS.index(k), i] += 1
                hashes.append(hashlib.sha256(digest(base).encode()).hexdigest())
                all_spans.append(digest(in_order(base + chosen(spans, accepted))))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, counts), pa.array(hashes, type=pa.string()), pa.array(all_spans, type=pa.string())], names=[id_col, *(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans"])

    return found.mapInArrow(decide, f"`{id_col}` {kind}, " + ", ".join(f"n_{k} bigint" for k in BASE_KINDS) + ", base_sha256 string, spans string")


def in_order(spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def chosen(spans: list[dict], accepted: np.ndarray) -> list[tuple[str, int, int]]:
    return [(s["kind"], s["start"], s["end"]) for s in spans if s["votes"] >= 0 and accepted[s["features"]]]


def redact(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows with each span of their text replaced by <KIND>; a null text stays null. Overlapping spans are merged under the first one's kind."""
    accepted, at = fit_counts(vote_counts(docs, text_col)).accepted(threshold), docs.columns.index(text_col)

    def clean(text: str) -> str:
        base = base_spans(text)
        more = [(s, e, k) for s, e, k, _, f in candidates(text, base) if accepted[encode(f, WIDTHS)]]
        spans = sorted([(s, e, BASE_KINDS[k]) for k, s, e in base] + more)
        if not spans:
            return text
        out, end = [], 0
        for s, e, k in spans:
            if s >= end:
                out += [text[end:s], f"<{k.upper()}>"]
            end = max(end, e)
        return "".join([*out, text[end:]])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if t is None else clean(t) for t in batch.column(at).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(rewrite, docs.schema)
