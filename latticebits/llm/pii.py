"""Personal data: fixed patterns, and a skip-chain conditional random field that carries their labels on.

Patterns find the base spans of each kind; they stay. Nodes of the field are the tokens (runs without white space)
that hold a digit or an @; other tokens are O by definition. A node has a label O, email, ip, card or phone with a
learned weight for each feature of its shape; neighbours share a learned transition weight; skip edges join a token
to the nearest earlier one of the same letters and digits, and one whose digits end like it, with a learned weight
for agreement, so evidence at one place reaches the others. Nodes under base spans are observed. Loopy message
passing gives each other node its marginals, in every text. Neighbours of which one kind has at least ADD of the
probability become one span if what they hold is a span of that kind by its pattern when read alone (the greedy patterns
lose numbers that stand beside others); any other such node becomes a span if skip edges lead from it to a base span of
the kind. Skip edges also join base cards and phones to runs of neighbouring tokens that repeat their digits.

All weights are trained together, by the gradient of the field's pseudo-likelihood (each label given its features and
the labels around it), on the base labels of a bounded sample: different texts chosen by their hash, of which
TRAIN_DOCS at most are expected, whatever repeats. Agreement has a prior mean, as few documents repeat what they say.

Defined results: null text counts as empty, without spans; offsets count code points, ends exclusive; kinds may
overlap each other, spans of one kind do not; repeated rows are treated alike; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latticebits.llm import shared

KINDS = ("email", "ip", "card", "phone")
TRAIN_DOCS, TRAIN_MAX_CHARS = 3000, 1 << 16
ADD = 0.5
#: Digits at the end of a number that tell it again.
REPEAT = 7
ROUNDS = 25
#: Weight of agreement before any skip edge is seen, and how many edges that counts for.
AGREE_PRIOR, AGREE_EDGES = 3.0, 20.0
_STEPS, _RATE, _MOMENTUM, _DECAY = 400, 0.3, 0.9, 1e-4

Span = tuple[int, int, int]  # kind, start, end

# The stated patterns; look-behinds only spare starts inside a run of digits, where no leftmost match can start.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NODE = re.compile(r"\S*[0-9@]\S*")
_DIGIT = re.compile(r"[0-9]")
_TRIM = ".,;:!?\"'()[]{}<>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    out: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        begin = at
        while begin > last and text[begin - 1] in _LOCAL:
            begin -= 1
        m = _EMAIL.match(text, begin) if begin < at else None
        if m:
            last = m.end()
            out.append((0, begin, last))
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
                out.append((1, m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _only_digits(m.group())) <= 19 and luhn(d):
                out.append((2, m.start(), m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_only_digits(m.group())) <= 15:
                    out.append((3, m.start(), m.end()))
    return out


# ---- the field

_FEATURES = 16


def _features(token: str) -> np.ndarray:
    x = np.zeros(_FEATURES)
    digits = _only_digits(token)
    n = len(digits)
    x[0] = 1
    x[1] = "@" in token
    x[2] = token.count(".") == 3 and all(p.isdigit() for p in token.split("."))
    x[3] = "-" in token
    x[4] = token[:1] == "+"
    x[5] = "(" in token or ")" in token
    x[6] = any(c.isalpha() for c in token)
    x[7 + min(5, (n > 0) + (n > 3) + (n > 6) + (n > 9) + (n > 12))] = 1
    x[13] = 13 <= n <= 19 and luhn(digits)
    x[14] = x[2] and all(len(p) <= 3 and int(p) <= 255 for p in token.split("."))
    x[15] = "=" in token or "_" in token
    return x


@dataclass
class Nodes:
    """Tokens of one text: where they are, their shapes, chain and skip edges, observed labels (-1: none)."""

    begin: list[int]
    end: list[int]
    x: np.ndarray
    observed: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def nodes_of(text: str, base: list[Span]) -> Nodes:
    begin, end, x, keys, tails = [], [], [], [], []
    chain: list[tuple[int, int]] = []
    skip: list[tuple[int, int]] = []
    latest: dict[str, int] = {}
    for m in _NODE.finditer(text):
        raw = m.group()
        token = raw.strip(_TRIM)
        if not token:
            continue
        lead = raw.find(token)
        if begin and text[end[-1] : m.start()].strip(_TRIM + " \t\n") == "" and m.start() - end[-1] <= 3:
            chain.append((len(begin) - 1, len(begin)))
        begin.append(m.start() + lead)
        end.append(m.start() + lead + len(token))
        x.append(_features(raw if raw[:1] in "+(" else token))
        keys.append("".join(c for c in token.lower() if c.isalnum()))
        digits = _only_digits(token)
        tails.append(digits[-7:] if len(digits) >= 7 and "@" not in token else "")
    for i in range(len(begin)):
        linked = set()
        for name in {"=" + keys[i], "~" + tails[i]}:
            if len(name) > 4:
                j = latest.get(name)
                if j is not None and j not in linked:
                    skip.append((j, i))
                    linked.add(j)
                latest[name] = i
    observed = np.full(len(begin), -1)
    starts = np.array(begin, dtype=np.int64)
    for kind, a, b in base:
        lo, hi = np.searchsorted(starts, [a, b])
        for i in range(max(0, lo - 1), hi):
            if begin[i] < b and end[i] > a:
                observed[i] = kind + 1
    shape = lambda e: np.array(e, dtype=np.int64).reshape(-1, 2)
    return Nodes(begin, end, np.array(x).reshape(-1, _FEATURES), observed, shape(chain), shape(skip))


def repeats(text: str, nodes: Nodes, base: list[Span]) -> np.ndarray:
    """Skip edges from the nodes of base cards and phones to neighbouring nodes that together repeat their digits, or at
    least their last REPEAT ones: a number may be cut into other tokens each time. Such nodes take the shape of their run."""
    digits = [_only_digits(text[a:b]) for a, b in zip(nodes.begin, nodes.end)]
    plain = [bool(d) and not any(c.isalpha() or c == "@" for c in text[a:b]) for d, a, b in zip(digits, nodes.begin, nodes.end)]
    near = {int(b) for _, b in nodes.chain}
    whole: dict[str, dict[tuple[int, str], list[int]]] = {}  # by the last digits: the owner of each digit, once a number
    for kind, a, b in base:
        if kind >= 2:
            own = [i for i in range(max(0, int(np.searchsorted(nodes.begin, a)) - 1), int(np.searchsorted(nodes.begin, b))) if nodes.end[i] > a]
            owner = [i for i in own for c in text[max(a, nodes.begin[i]) : min(b, nodes.end[i])] if "0" <= c <= "9"]
            number = _only_digits(text[a:b])
            if len(owner) == len(number):
                whole.setdefault(number[-REPEAT:], {}).setdefault((kind, number), owner)
    edges = {(int(a), int(b)) for a, b in nodes.skip}
    new = []
    for end in range(len(digits) if whole else 0):
        tail, i = "", end + 1
        while len(tail) < REPEAT and i > 0 and plain[i - 1] and (i > end or i in near):
            i -= 1
            tail = digits[i] + tail
        for (_, number), owner in whole.get(tail[-REPEAT:], {}).items():
            left, i = len(number), end
            if len(digits[end]) >= REPEAT and not number.endswith(digits[end]):
                pairs = {(owner[-k], end) for k in range(1, REPEAT + 1)}
                left -= REPEAT
            else:
                pairs = set()
                while i >= 0 and plain[i] and (i == end or i + 1 in near) and left and number[:left].endswith(digits[i]):
                    pairs |= {(owner[left - k], i) for k in range(1, len(digits[i]) + 1)}
                    left -= len(digits[i])
                    i -= 1
            if len(number) - left >= REPEAT:
                new += [e for e in sorted(pairs) if e[0] != e[1] and e not in edges and e[::-1] not in edges]
                edges |= pairs
                for k in {k for _, k in pairs if nodes.observed[k] < 0 and len(pairs) and i + 1 < end}:
                    nodes.x[k] = _features(text[nodes.begin[i + 1] : nodes.end[end]])
    return np.array(new, dtype=np.int64).reshape(-1, 2)


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    transition: np.ndarray  # labels x labels
    agreement: float

    @classmethod
    def fit(cls, texts: list[str]) -> Field:
        """Maximum pseudo-likelihood with base labels, unlabelled nodes counting as O."""
        labels = len(KINDS) + 1
        hot = np.eye(labels)
        rows = [np.zeros((0, _FEATURES + 3 * labels + 1))]  # features, labels before, behind and at skip edges, own label
        for text in texts:
            nodes = nodes_of(text, base_spans(text))
            y = np.maximum(nodes.observed, 0)
            around = np.zeros((3, len(y), labels))
            np.add.at(around[0], nodes.chain[:, 1], hot[y[nodes.chain[:, 0]]])
            np.add.at(around[1], nodes.chain[:, 0], hot[y[nodes.chain[:, 1]]])
            np.add.at(around[2], nodes.skip[:, 0], hot[y[nodes.skip[:, 1]]])
            np.add.at(around[2], nodes.skip[:, 1], hot[y[nodes.skip[:, 0]]])
            rows.append(np.column_stack([nodes.x, *around, y]))
        # few different neighbourhoods: the fit does not grow with the sample
        seen, times = np.unique(np.concatenate(rows), axis=0, return_counts=True)
        x, before, behind, skip = np.split(seen[:, :-1], [_FEATURES, _FEATURES + labels, _FEATURES + 2 * labels], axis=1)
        y, n = hot[seen[:, -1].astype(int)], max(1, int(times.sum()))
        w, transition, agreement = np.zeros((_FEATURES, labels)), np.zeros((labels, labels)), np.array(AGREE_PRIOR)
        speed = [np.zeros_like(w), np.zeros_like(transition), np.zeros_like(agreement)]
        for _ in range(_STEPS):
            score = x @ w + before @ transition + behind @ transition.T + agreement * skip
            p = np.exp(score - score.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            miss = times[:, None] * (y - p) / n
            slopes = (x.T @ miss - _DECAY * w, before.T @ miss + (behind.T @ miss).T - _DECAY * transition, (skip * miss).sum() - AGREE_EDGES / n * (agreement - AGREE_PRIOR))
            speed = [_MOMENTUM * v + _RATE * g for v, g in zip(speed, slopes)]
            w, transition, agreement = w + speed[0], transition + speed[1], agreement + speed[2]
        return cls(w, transition, float(agreement))

    def marginals(self, nodes: Nodes) -> np.ndarray:
        """Loopy sum-product over all edges at once, damped; exact on trees."""
        labels = self.weights.shape[1]
        unary = nodes.x @ self.weights
        seen = nodes.observed >= 0
        unary[seen] = -50.0
        unary[seen, nodes.observed[seen]] = 0.0
        unary = np.exp(unary - unary.max(axis=1, keepdims=True))
        agree = np.exp(self.agreement * np.eye(labels))
        forth = np.exp(self.transition)
        edges = np.concatenate([nodes.chain, nodes.skip])
        n = len(edges)
        source, target = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        is_skip = np.arange(n) >= len(nodes.chain)
        factor = np.where(np.concatenate([is_skip, is_skip])[:, None, None], agree, np.stack([forth] * n + [forth.T] * n) if n else np.zeros((0, labels, labels)))
        reverse = np.concatenate([np.arange(n, 2 * n), np.arange(n)])
        log_message = np.zeros((2 * n, labels))
        log_unary = np.log(unary + 1e-300)
        for _ in range(ROUNDS):
            belief = log_unary.copy()
            np.add.at(belief, target, log_message)
            send = belief[source] - log_message[reverse]
            send = np.exp(send - send.max(axis=1, keepdims=True))
            new = np.einsum("es,est->et", send, factor)
            new = np.log(new / new.sum(axis=1, keepdims=True) + 1e-300)
            done = np.abs(new - log_message).max(initial=0.0) < 1e-6
            log_message = 0.5 * log_message + 0.5 * new
            if done:
                break
        belief = log_unary.copy()
        np.add.at(belief, target, log_message)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        nodes = nodes_of(text, base)
        if not (nodes.observed < 0).any():
            return []
        nodes.skip = np.concatenate([nodes.skip, repeats(text, nodes, base)])
        # which kinds reach a node by skip edges
        reach = np.zeros((len(nodes.begin), len(KINDS) + 1), dtype=bool)
        own = nodes.observed > 0
        reach[own, nodes.observed[own]] = True
        while True:
            before = reach.sum()
            np.logical_or.at(reach, nodes.skip[:, 1], reach[nodes.skip[:, 0]])
            np.logical_or.at(reach, nodes.skip[:, 0], reach[nodes.skip[:, 1]])
            if reach.sum() == before:
                break
        p = self.marginals(nodes)
        kinds = p[:, 1:].argmax(axis=1) + 1
        kinds[(nodes.observed >= 0) | (p[np.arange(len(p)), kinds] < ADD)] = 0
        out, i = [], 0
        near = {int(b) for _, b in nodes.chain}  # nodes that have a neighbour before them
        while i < len(kinds):
            kind, j = int(kinds[i]), i + 1
            if kind:
                # the longest run of neighbours of this kind that is a span of it when read alone
                digits = [len(_only_digits(text[nodes.begin[i] : nodes.end[i]]))]
                while j < len(kinds) and j in near and kinds[j] == kind and sum(digits) <= 19:
                    digits.append(len(_only_digits(text[nodes.begin[j] : nodes.end[j]])))
                    j += 1
                while j > i and (kind - 1, 0, nodes.end[j - 1] - nodes.begin[i]) not in base_spans(text[nodes.begin[i] : nodes.end[j - 1]]):
                    j -= 1
                if j > i:
                    out.append((kind - 1, nodes.begin[i], nodes.end[j - 1]))
                elif reach[i, kind]:
                    out.append((kind - 1, nodes.begin[i], nodes.end[i]))
            i = max(j, i + 1)
        return out


# ---- operators


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    usable = shared.columns(docs, "doc_id", "text").where((F.length("text") <= TRAIN_MAX_CHARS) & F.col("text").rlike("[0-9@]"))
    rate = min(1.0, train_docs / max(usable.count(), 1))
    drawn = usable.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.lit(int(rate * (1 << 30)))).select("text").distinct()
    return Field.fit(sorted(r[0] for r in drawn.collect()))  # about train_docs at most, as repeated texts count once


def find(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a text, each sorted."""
    base = sorted(base_spans(text))
    return base, sorted(field.added(text, base))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


_DIGEST = "struct<n_email: bigint, n_ip: bigint, n_card: bigint, n_phone: bigint, base_sha256: string, spans: string, n_added: bigint, n_spans: bigint>"
_NAMES = ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added", "n_spans")


def digests(field: Field):
    """A function from a text column to the digest struct."""

    @F.arrow_udf(_DIGEST)
    def digest(text: pa.Array) -> pa.Array:
        out: list[list] = [[] for _ in _NAMES]
        for t in text:
            base, added = find(t.as_py() or "", field)
            counts = [0, 0, 0, 0]
            for kind, _, _ in base:
                counts[kind] += 1
            for column, value in zip(out, (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + added)), len(added), len(base) + len(added))):
                column.append(value)
        return pa.StructArray.from_arrays([pa.array(c, pa.string() if i in (4, 5) else pa.int64()) for i, c in enumerate(out)], list(_NAMES))

    return digest


def redact_text(text: str, spans: list[Span]) -> str:
    """Spans replaced by their kind in brackets; overlapping ones by the first kind."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a] + f"[{KINDS[kind].upper()}]")
        at = b
    return "".join(out) + text[at:]


def redacted(field: Field):
    """A function from a text column to the text without personal data; null stays null."""

    @F.arrow_udf("string")
    def redact(text: pa.Array) -> pa.Array:
        out = []
        for t in text:
            t = t.as_py()
            out.append(redact_text(t, [s for part in find(t, field) for s in part]) if t else t)
        return pa.array(out, pa.string())

    return redact


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.documents(spark, sf_dir)
    r = digests(train(docs))(F.col("text"))
    return shared.columns(docs, "doc_id", "text").select("doc_id", r.alias("r")).select("doc_id", *[F.col(f"r.{n}").alias(n) for n in _NAMES])
