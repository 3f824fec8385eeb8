"""Personal data: base patterns, and a skip-chain conditional random field.

The base patterns find e-mail addresses, IP addresses, card numbers and phone
numbers.  The field labels the words that hold a digit or an at sign, the
others being outside by definition.  Neighbouring words share chain potentials.
Words that repeat, however far apart, or whose digits do (all of them, or the
last seven), share skip potentials.  Loopy sum-product messages make labels
agree over the document, so a number that is named as a phone number once is
found where it stands bare.  A group of equal words is linked occurrence to
occurrence, never pair by pair.

The weights are trained by pseudo-likelihood, under a prior that repeats agree
(samples hold few of them), on a bounded sample, labelled by the base patterns:
of the documents with a candidate and at most ``sample_chars`` characters, the
``sample_docs`` whose texts have the least hashes.
Words that the patterns leave but that share a skip link with a word they label
count as unlabelled.  The field adds spans and never takes a base span away.

Messages pass until they settle, so a label reaches every repeat of its word.

Defined results: a null text is an empty one without spans; repeated rows get
the same result each; texts of one hash are one in the sample; with no candidate
in the table there is no field, and base spans remain; every text is searched
whole, and texts are taken together up to a number of characters, so a very long
one is taken by itself; columns named like a result are replaced; an empty table
gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.llm.pieces import by_size
from tracewell.llm.workspace import Aside, read_documents

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is trained on, at most, and their length, at most.
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
#: Change of any message below which all have settled; rounds after which those
#: that swing are taken as they stand.
SETTLED, ROUNDS, DAMPING, SURE = 1e-4, 1000, 0.3, 0.6
#: Characters of texts that are searched together.
BATCH_CHARS = 2_000_000
#: Where the weights of equal labels over a skip link are drawn to: repeats agree.
AGREE = 6.0

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CANDIDATE = re.compile(r"[0-9@]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")

Span = tuple[str, int, int]


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses; linear however long a run of letters is."""
    free = 0
    at = text.find("@")
    while at >= 0:
        local = len(text[free:at]) - len(text[free:at].rstrip(_LOCAL))
        free, found = at + 1, _DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
            free = found.end()
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    """The check sum of card numbers."""
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else sum(divmod(2 * v, 10)) for k, v in enumerate(values)) % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind as listed and start."""
    found: list[Span] = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if re.search("[0-9]", text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if 16 <= len(m[0]) and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return found


@dataclass
class Candidates:
    """Words of one document that may be personal data."""

    spans: list[tuple[int, int]]
    place: np.ndarray  # the number of the word in the document
    words: list[str]

    @classmethod
    def of(cls, text: str) -> Candidates:
        spans, place = [], []
        if _CANDIDATE.search(text):
            for k, m in enumerate(_WORD.finditer(text)):
                if _CANDIDATE.search(m[0]):
                    spans.append(m.span())
                    place.append(k)
        return cls(spans, np.array(place, np.int64), [text[a:b] for a, b in spans])

    def chain(self) -> np.ndarray:
        """Pairs of candidates that are neighbouring words."""
        left = np.flatnonzero(np.diff(self.place) == 1) if len(self.place) > 1 else np.empty(0, np.int64)
        return np.stack([left, left + 1], 1)

    def skips(self) -> np.ndarray:
        """Pairs of consecutive candidates that repeat or share their digits."""
        last: dict[str, int] = {}
        found = set()
        for i, word in enumerate(self.words):
            digits = _digits(word)
            keys = {f"w{word.lower().strip('.,;:!?()')}"} if "@" in word or len(digits) >= 4 else set()
            if len(digits) >= 6:
                keys.add(f"d{digits}")
            if 7 <= len(digits) <= 15:
                keys.add(f"t{digits[-7:]}")
            for key in keys:
                if key in last and self.place[i] - self.place[last[key]] > 1:
                    found.add((last[key], i))
                last[key] = i
        return np.array(sorted(found), np.int64).reshape(-1, 2)


def features(found: Candidates) -> np.ndarray:
    """Binary observations of each candidate and its neighbours."""
    own = []
    for word in found.words:
        bare = word.strip(".,;:!?\"'")
        digits = _digits(bare)
        n, parts = len(digits), bare.split(".")
        letters = any(c.isalpha() for c in bare)
        own.append(
            [
                "@" in bare,
                "@" in bare and "." in bare.partition("@")[2],
                len(parts) == 4 and all(p.isdigit() for p in parts),
                bare.startswith("+"),
                bare.startswith("(") and bare.endswith(")"),
                n in (1, 2),
                n == 3,
                4 <= n <= 6,
                n == 7,
                8 <= n <= 12,
                13 <= n <= 19,
                n > 19,
                n >= 13 and not letters and luhn(digits),
                letters,
                "-" in bare,
                "=" in bare or '"' in word,
            ]
        )
    own_matrix = np.array(own, np.float64).reshape(len(own), 16)
    before, after = np.zeros_like(own_matrix), np.zeros_like(own_matrix)
    for left, right in found.chain():
        before[right], after[left] = own_matrix[left], own_matrix[right]
    return np.hstack([np.ones((len(own), 1)), own_matrix, before, after])


def overlapping(spans: list[tuple[int, int]], base: list[Span]) -> np.ndarray:
    """The kind of the base span that each word overlaps, from 1; 0 for none."""
    labels = np.zeros(len(spans), np.int64)
    for k, kind in enumerate(KINDS):
        mine = sorted((a, b) for name, a, b in base if name == kind)
        at = 0
        for i, (a, b) in enumerate(spans):
            while at < len(mine) and mine[at][1] <= a:
                at += 1
            if at < len(mine) and mine[at][0] < b:
                labels[i] = k + 1
    return labels


@dataclass
class SkipChain:
    """Weights: observations by label, labels of neighbours, labels over skips."""

    unary: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    @classmethod
    def trained(cls, texts: list[str], steps: int = 400, decay: float = 1e-3) -> SkipChain | None:
        """Pseudo-likelihood: each label given its neighbours' labels."""
        labels_n = len(KINDS) + 1
        rows, wanted, use = [], [], []
        for text in texts:
            found = Candidates.of(text)
            if not found.words:
                continue
            labels = overlapping(found.spans, base_spans(text))
            one = np.eye(labels_n)[labels]
            prev, following, over = (np.zeros_like(one) for _ in range(3))
            for left, right in found.chain():
                prev[right], following[left] = one[left], one[right]
            seen = np.ones(len(labels), bool)
            for left, right in found.skips():
                over[left] += one[right]
                over[right] += one[left]
                if (labels[left] == 0) != (labels[right] == 0):
                    seen[left if labels[left] == 0 else right] = False
            rows.append(np.hstack([features(found), prev, following, over]))
            wanted.append(labels)
            use.append(seen)
        if not rows:
            return None
        keep = np.concatenate(use)
        x, y = np.concatenate(rows)[keep], np.eye(labels_n)[np.concatenate(wanted)[keep]]
        n_own = x.shape[1] - 3 * labels_n
        prior = np.zeros((x.shape[1], labels_n))
        prior[-labels_n:] = AGREE * np.eye(labels_n)
        w = prior.copy()
        m, v = np.zeros_like(w), np.zeros_like(w)
        for step in range(1, steps + 1):
            z = x @ w
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = x.T @ (p - y) / len(x) + decay * (w - prior)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        ahead, back, over = np.split(w[n_own:], 3)
        # a potential belongs to both ends: what follows is the transpose of what comes before
        return cls(w[:n_own], (ahead + back.T) / 2, (over + over.T) / 2)

    def posterior(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Marginals of every word by damped loopy sum-product messages."""
        source = np.concatenate([chain[:, 0], chain[:, 1], skip[:, 0], skip[:, 1]])
        target = np.concatenate([chain[:, 1], chain[:, 0], skip[:, 1], skip[:, 0]])
        c, s = len(chain), len(skip)
        back = np.concatenate([np.arange(c) + c, np.arange(c), 2 * c + s + np.arange(s), 2 * c + np.arange(s)])
        potentials = np.stack([self.chain, self.chain.T, self.skip])
        which = np.repeat([0, 1, 2], [c, c, 2 * s])
        messages = np.zeros((len(source), unary.shape[1]))
        belief = unary.copy()
        for _ in range(ROUNDS if len(source) else 0):
            cavity = belief[source] - messages[back]
            joint = cavity[:, :, None] + potentials[which]
            top = joint.max(1, keepdims=True)
            new = np.log(np.exp(joint - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            new = DAMPING * messages + (1 - DAMPING) * new
            moved, messages = np.abs(new - messages).max(), new
            belief = unary.copy()
            np.add.at(belief, target, messages)
            if moved < SETTLED:
                break
        p = np.exp(belief - belief.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, texts: list[str], bases: list[list[Span]]) -> list[list[Span]]:
        """Spans besides the base ones, for several documents at once."""
        found = [Candidates.of(t) for t in texts]
        sizes = [len(f.words) for f in found]
        if not sum(sizes):
            return [[] for _ in texts]
        offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        stacked = [(features(f), f.chain() + o, f.skips() + o) for f, o in zip(found, offsets, strict=True) if f.words]
        x, chain, skip = (np.concatenate(c) for c in zip(*stacked, strict=True))
        p = self.posterior(x @ self.unary, chain, skip)
        best = p.argmax(1)
        best[p.max(1) < SURE] = 0
        result = []
        for f, base, o in zip(found, bases, offsets, strict=True):
            labels = best[o : o + len(f.words)]
            labels = np.where(overlapping(f.spans, base) > 0, 0, labels)
            spans: list[Span] = []
            for i in np.flatnonzero(labels):
                a, b = _trimmed(f.words[i], f.spans[i][0])
                joins = i > 0 and labels[i - 1] == labels[i] and f.place[i] - f.place[i - 1] == 1
                if joins and spans:
                    spans[-1] = (spans[-1][0], spans[-1][1], b)
                else:
                    spans.append((KINDS[labels[i] - 1], a, b))
            result.append(spans)
        return result


def _trimmed(word: str, start: int) -> tuple[int, int]:
    left = len(word) - len(word.lstrip(".,;:!?\"'<>[]{}"))
    return start + left, start + max(left + 1, len(word.rstrip(".,;:!?\"'<>[]{}")))


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), *s[1:])))


def train(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> SkipChain | None:
    """A field trained on a sample that doesn't depend on the order of rows.

    Rows are counted first, and only those whose hash is in a share of all hashes
    that should hold some times the sample are looked over for the least; where
    copies make that too few, the share grows.  So what reaches the driver is
    bounded by the sample, however large the table is.
    """
    fit = F.col(text_col).rlike("[0-9@]") & (F.length(text_col) <= sample_chars)
    texts = docs.filter(fit).select(F.xxhash64(text_col).alias("hash"), F.col(text_col).alias("text"))
    rows = texts.count()
    share = min(1.0, 4 * sample_docs / max(1, rows))
    while True:
        within = texts if share == 1 else texts.filter(F.col("hash") < int(share * 2**64) - 2**63)
        sample = within.groupBy("hash").agg(F.first("text").alias("text")).orderBy("hash").limit(sample_docs).collect()
        if len(sample) >= sample_docs or share == 1:
            return SkipChain.trained([r["text"] for r in sample])
        share = min(1.0, 4 * share)


def find_personal_data(docs: DataFrame, text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """``docs`` with n_email, n_ip, n_card, n_phone, base_spans and spans.

    Spans are ``kind:start:end`` in code points, end exclusive, joined by commas.
    """
    results = [f"n_{k}" for k in KINDS] + ["base_spans", "spans"]
    aside = Aside(docs, *results)
    docs, text_col, names = aside.docs, aside(text_col), aside.own
    field = train(docs, text_col, sample_docs)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            done = 0
            for texts in by_size((t.as_py() or "" for t in whole.column(names.index(text_col))), BATCH_CHARS):
                batch, done = whole.slice(done, len(texts)), done + len(texts)
                bases = [base_spans(t) for t in texts]
                more = field.added(texts, bases) if field else [[] for _ in texts]
                counts = [pa.array([sum(s[0] == k for s in b) for b in bases], pa.int64()) for k in KINDS]
                said = [pa.array([_said(b) for b in bases]), pa.array([_said(b + m) for b, m in zip(bases, more, strict=True)])]
                yield pa.RecordBatch.from_arrays([*batch.columns, *counts, *said], [*names, *results])

    added = [T.StructField(name, T.LongType() if name.startswith("n_") else T.StringType()) for name in results]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(search, schema).select(*aside.back, *results)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    found = find_personal_data(docs)
    return found.select("doc_id", *[f"n_{k}" for k in KINDS], F.sha2("base_spans", 256).alias("base_sha256"), "spans")
