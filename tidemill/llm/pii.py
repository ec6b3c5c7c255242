"""Personal data by a skip-chain conditional random field over number-like and address-like units of a text.

A base scan finds e-mail addresses, IP addresses, card and phone numbers by pattern. Each unit of
a document (a run of digits and separators, or a word with an at sign) is then a variable with a
label: none, or a kind that its form allows. Units next to each other share a chain potential,
units of equal or similar content anywhere in the document a skip potential that favours equal
labels, none among them. So repeats agree, and lift each other only where there is evidence: units
in base spans have their kind. Loopy message passing until it settles gives each unit's marginal.
What the marginals find beyond the base spans is added, such as a phone number that is written in
full once and without its prefix elsewhere.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import from_text, map_texts, release

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*")
_NO_DIGIT = re.compile("[^0-9]")
_PART = re.compile("[ .-]")
_COUNTRY = re.compile(r"^\+[0-9]{1,3}[\x20().-]*")
NEVER = -40.0  # log potential of a label that can't be
NEAR = 40  # characters between two units that are neighbours
_ANY = re.compile("[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, from one at sign to the next, so that no long word is scanned twice."""
    free = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            free = m.end()
        else:
            free = at + 1 if start == at else free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """The base scan's spans by kind as listed, then start; ends are exclusive, places count code points."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", a, b) for a, b in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _NO_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return out


# Classes of the number of digits, by the least number of each.
SIZES = (1, 7, 9, 13, 16, 20)
SAME, SIMILAR = 1, 2


@dataclass
class Unit:
    start: int
    end: int
    shape: tuple
    keys: tuple
    label: int


def shape_of(own: str) -> tuple[tuple, tuple]:
    """A unit's shape (at sign, dotted host, class of its number of digits, form of an IP address, plus sign, a card's check digit, separators) and its keys."""
    digits = _NO_DIGIT.sub("", own)
    n = len(digits)
    name, at, host = own.partition("@")
    parts = _PART.split(own)
    four = not at and len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in parts)
    shape = (bool(at and name and host), bool(at) and "." in host.strip("."), bisect_right(SIZES, n), four, own[:1] == "+", not at and 13 <= n <= 19 and luhn(digits), n < len(own))
    if at:
        return shape, ((SAME, own.lower().strip(".-")), (SIMILAR, name.lower())) if name and host else ()
    if four:
        return shape, ((SAME, ".".join(str(int(p)) for p in parts)),)
    keys = ((SAME, digits),) if n >= 7 else ()
    return shape, (*keys, (SIMILAR, digits[-9:])) if n >= 9 else keys


def allowed(shape: tuple) -> np.ndarray:
    """Which labels a unit outside base spans can have."""
    address, _, size, four, _, check, _ = shape
    return np.array([True, address, four, check, not address and 2 <= size <= 4 and not four])


def units(text: str, base: list[Span]) -> list[Unit]:
    """The units of a text in order: base spans, and what is left of its number-like runs and words with an at sign."""
    found = [(a, b, KINDS.index(kind) + 1) for kind, a, b in base]
    found.sort(key=lambda x: (x[0], -x[1]))
    taken: list[tuple[int, int, int]] = []
    for x in found:
        if not taken or x[0] >= taken[-1][1]:
            taken.append(x)
    rest: list[tuple[int, int, int]] = []
    at = text.find("@")
    while at >= 0:
        a, b = at, at + 1
        while a > 0 and text[a - 1] in _LOCAL:
            a -= 1
        while b < len(text) and (text[b] in _LOCAL):
            b += 1
        rest.append((a, b, 0))
        at = text.find("@", b)
    rest += [(m.start(), m.end(), 0) for m in _NUMBER.finditer(text)]
    rest.sort()
    merged, i, last = [], 0, 0
    for x in rest:
        while i < len(taken) and taken[i][1] <= x[0]:
            i += 1
        if (i == len(taken) or taken[i][0] >= x[1]) and x[0] >= last:
            merged.append(x)
            last = x[1]
    return [Unit(a, b, *shape_of(text[a:b]), label) for a, b, label in sorted(taken + merged)]


def features(shape: tuple) -> np.ndarray:
    address, host, size, four, plus, check, spaced = shape
    x = np.zeros(14)
    x[0], x[1], x[2], x[3], x[4], x[5], x[6] = 1, address, host, four, plus, check, spaced
    x[7 + size] = 1
    return x


def skips(found: list[Unit]) -> list[tuple[int, int, int]]:
    """Pairs (left, right, SAME or SIMILAR) of units that share a key: each with the one before it, and with the nearest evidence on both sides.

    Their number follows the number of units; by the links to evidence a label reaches any repeat in one step.
    """
    pairs: dict[tuple[int, int], int] = {}
    last: dict[tuple, int] = {}
    for i, u in enumerate(found):
        for key in u.keys:
            if key in last:
                pairs.setdefault((last[key], i), key[0])
            last[key] = i
    for step in (range(len(found)), range(len(found) - 1, -1, -1)):
        known: dict[tuple, int] = {}
        for i in step:
            for key in found[i].keys:
                if found[i].label:
                    known[key] = i
                elif key in known:
                    j = known[key]
                    pairs.setdefault((min(i, j), max(i, j)), key[0])
    return [(a, b, kind) for (a, b), kind in pairs.items()]


def links_of(found: list[Unit]) -> dict[tuple[int, int], tuple[int, int]]:
    """For each linked pair whether the two are neighbours, and the kind of their skip (0 for none)."""
    out = {(i, i + 1): (1, 0) for i in range(len(found) - 1) if found[i + 1].start - found[i].end <= NEAR}
    for a, b, kind in skips(found):
        out[a, b] = (out.get((a, b), (0, 0))[0], kind)
    return out


def spanning_share(n: int, pairs: list[tuple]) -> np.ndarray:
    """For each link the share of links that a spanning tree of its part of the graph has: 1 where there is no loop."""
    root = list(range(n))

    def of(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b, *_ in pairs:
        x, y = of(a), of(b)
        root[max(x, y)] = min(x, y)
    part = [of(a) for a, *_ in pairs]
    links, members = Counter(part), Counter(of(i) for i in range(n))
    return np.array([(members[p] - 1) / links[p] for p in part])


@dataclass
class Field:
    """Weights of the unit potentials by feature and label, log potentials of two neighbours, and what equal labels of the same or similar content gain."""

    weights: np.ndarray
    chain: np.ndarray
    same: float = 4.0
    similar: float = 3.0

    def local(self, found: list[Unit]) -> np.ndarray:
        """Log potentials of each unit alone: a base span has its kind, any other unit only what its form allows.

        Units of the same content are one observation: they share its potential in equal parts.
        """
        shapes = list({u.shape for u in found})
        at = {s: i for i, s in enumerate(shapes)}
        table = np.stack([features(s) @ self.weights for s in shapes])
        own = [u.keys[0] if u.keys and not u.label else i for i, u in enumerate(found)]
        n = Counter(own)
        out = table[[at[u.shape] for u in found]] / np.array([n[k] for k in own])[:, None]
        out[~np.stack([allowed(s) for s in shapes])[[at[u.shape] for u in found]]] = NEVER
        for i, u in enumerate(found):
            if u.label:
                out[i] = NEVER
                out[i, u.label] = 0.0
        return out

    def marginals(self, found: list[Unit], rounds: int = 1000, least: float = 1e-6, block: int = 1 << 14) -> np.ndarray:
        """Label probabilities of each unit, once no message changes by more than ``least`` (or after ``rounds``).

        Links to evidence are exact and need no messages. Among the other units messages are damped
        by half and tree-reweighted: in a part of the graph with loops, each link counts as often as
        in the mean spanning tree, so that units don't confirm themselves around a loop. Where there
        is none the result is exact. Memory follows the number of links.
        """
        local = self.local(found)
        n, k = local.shape
        gains = (0.0, self.same, self.similar)
        free = []
        for (a, b), (near, kind) in links_of(found).items():
            if found[a].label and found[b].label:
                continue
            if not found[a].label and not found[b].label:
                free.append((a, b, near, kind))
                continue
            i, x = (b, found[a].label) if found[a].label else (a, found[b].label)
            local[i, x] += gains[kind]
            if near:
                local[i] += self.chain[x] if i == b else self.chain[:, x]
        belief = local
        if free:
            share = spanning_share(n, free)[:, None, None]
            a, b, near, kind = np.array(free).T
            m = len(a)
            source, target = np.concatenate([a, b]), np.concatenate([b, a])
            both = np.concatenate([share, share])[:, 0, 0]
            gain, near = np.array(gains)[kind][:, None, None], near[:, None, None]
            messages = np.zeros((2 * m, k))
            total = lambda: local + np.stack([np.bincount(target, both * messages[:, j], n) for j in range(k)], axis=1)
            for _ in range(rounds):
                belief, change, fresh = total(), 0.0, np.empty_like(messages)
                for lo in range(0, 2 * m, block):
                    e = np.arange(lo, min(lo + block, 2 * m))
                    of = e % m
                    send = belief[source[e]] - messages[(e + m) % (2 * m)]
                    send = np.exp(send - send.max(axis=1, keepdims=True))
                    chain = np.where((e < m)[:, None, None], self.chain[None], self.chain.T[None])
                    got = np.einsum("ei,eij->ej", send, np.exp((near[of] * chain + gain[of] * np.eye(k)) / share[of]))
                    got = np.log(got)
                    got -= got.max(axis=1, keepdims=True)
                    fresh[e] = 0.5 * (messages[e] + got)
                    change = max(change, float(np.abs(got - messages[e]).max()))
                messages = fresh
                if change < least:
                    break
            belief = total()
        p = np.exp(belief - belief.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def hidden(kind: str, own: str) -> list[tuple[str, int]]:
    """What a base span would be without its mark, with how its content is linked to it: examples of units to be found."""
    if kind == "phone":
        return [(own[1:], SAME), (_COUNTRY.sub("", own), SIMILAR)]
    if kind == "email":
        return [(own.rsplit(".", 1)[0], SIMILAR)]
    return [(own.replace(".", "-"), SAME)] if kind == "ip" else [(_PART.sub(".", own), SAME)]


def learn(counts: dict[tuple, float], chain: np.ndarray, steps: int = 3000, penalty: float = 2e-4) -> Field:
    """Weights of units and skips together, by penalised maximum likelihood on counts by (shape, link, kind linked to, label).

    The penalty draws the skip weights to 4 and 3 and the weight of no label to 2, which they keep
    where there is nothing to learn from.
    """
    k = len(KINDS) + 1
    prior = np.zeros((len(features((False,) * 7)), k))
    prior[0, 0] = 2.0
    weights, skip, start = prior.copy(), np.array([4.0, 3.0]), np.array([4.0, 3.0])
    rows = sorted(counts)
    if rows:
        x = np.stack([features(s) for s, *_ in rows])
        mask = np.stack([allowed(s) for s, *_ in rows])
        link, to, label = (np.array([r[c] for r in rows]) for c in (1, 2, 3))
        n = np.sqrt(np.array([counts[r] for r in rows], float))  # frequent shapes don't drown rare ones
        y, of = np.eye(k)[label], np.eye(k)[to] * (link > 0)[:, None]
        usable = mask[np.arange(len(rows)), label]
        n = n * usable / max(1.0, (n * usable).sum())
        fast, fast_skip = np.zeros_like(weights), np.zeros(2)
        for _ in range(steps):
            z = np.where(mask, x @ weights + np.where(link > 0, skip[link - 1], 0.0)[:, None] * of, NEVER)
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            error = n[:, None] * (y - p)
            pull = (error * of).sum(1)
            fast = 0.9 * fast + x.T @ error - penalty * (weights - prior)
            fast_skip = 0.9 * fast_skip + np.array([pull[link == c].sum() for c in (SAME, SIMILAR)]) - penalty * (skip - start)
            weights, skip = weights + 0.3 * fast, skip + 0.3 * fast_skip
        skip = np.maximum(skip, 0.0)
    smooth = chain + 1.0
    pmi = np.log(smooth / smooth.sum()) - np.log(smooth.sum(1, keepdims=True) / smooth.sum()) - np.log(smooth.sum(0, keepdims=True) / smooth.sum())
    return Field(weights, np.clip(pmi, -1.0, 1.0), float(skip[0]), float(skip[1]))


def examples(text: str) -> tuple[Counter, Counter]:
    """Counts by (shape, link, kind linked to, label), and of neighbouring labels.

    Units that share no key with evidence have no label. Each base span gives examples of itself
    without its mark, linked to it, and of that form with no link, which is none. Units linked to
    evidence are what is to be found, and left out.
    """
    base = base_spans(text)
    found = units(text, base)
    seen, near = Counter(), Counter()
    known = {key for u in found if u.label for key in u.keys}
    for u in found:
        if u.label:
            for own, link in hidden(KINDS[u.label - 1], text[u.start : u.end]):
                shape = shape_of(own)[0]
                seen[shape, link, u.label, u.label] += 1
                seen[shape, 0, 0, 0] += 1
        elif not known.intersection(u.keys):
            seen[u.shape, 0, 0, 0] += 1
    near.update((a.label, b.label) for a, b in zip(found, found[1:]) if b.start - a.end <= NEAR)
    return seen, near


def fit(docs: DataFrame, text_col: str = "text") -> Field:
    """A field learned from what the base scan says of the units of all documents with a digit or an at sign.

    Counts by shape, link and label (a few hundred rows at most) come to the driver, no texts.
    """
    rows = docs.filter(F.col(text_col).rlike("[0-9@]")).select(F.col(text_col).alias("text"))
    shape = T.StructType([T.StructField("key", T.StringType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units_of: Counter = Counter()
        near_of: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen, near = examples(text)
                units_of.update(seen)
                near_of.update(near)
        found = {",".join(str(int(v)) for v in (*s, *rest)): n for (s, *rest), n in units_of.items()} | {f"{a},{b}": n for (a, b), n in near_of.items()}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["key", "n"])
        release()

    counts: dict[tuple, float] = {}
    chain = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
    for r in rows.mapInArrow(count, shape).groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").collect():
        v = [int(x) for x in r["key"].split(",")]
        if len(v) == 2:
            chain[v[0], v[1]] += r["n"]
        else:
            counts[(bool(v[0]), bool(v[1]), v[2], *map(bool, v[3:7])), *v[7:]] = r["n"]
    return learn(counts, chain)


def all_spans(text: str, field: Field, least: float = 0.9) -> tuple[list[Span], list[Span]]:
    """The base spans, and those with what the field adds: units whose marginal of a kind is ``least`` or more."""
    if not _ANY.search(text):
        return [], []
    base = base_spans(text)
    found = units(text, base)
    if not any(not u.label and allowed(u.shape)[1:].any() for u in found):
        return base, base
    added = [(KINDS[int(q.argmax()) - 1], u.start, u.end) for u, q in zip(found, field.marginals(found), strict=True) if not u.label and q.argmax() and q.max() >= least]
    return base, sorted(base + added, key=lambda s: (KINDS.index(s[0]), s[1]))


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FIELDS = T.StructType([
    *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS),
    T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
])


def find(docs: DataFrame, field: Field, keep: list[str], text_col: str = "text") -> DataFrame:
    """``keep`` columns of every row with the numbers of base spans by kind, the SHA-256 of their list, and the list of all spans.

    Null and empty texts have none. Repeated rows give equal rows, an empty table none. Marginals
    under 0.9 add nothing.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def start() -> Callable[[list[str | None]], list[list]]:
        def work(texts: list[str | None]) -> list[list]:
            rows = []
            for text in texts:
                base, spans = all_spans(text or "", shared.value)
                n = Counter(s[0] for s in base)
                rows.append((*(n[k] for k in KINDS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
            return [list(c) for c in zip(*rows, strict=True)]

        return work

    return map_texts(docs, text_col, keep, FIELDS, start)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each span replaced by its kind in angle brackets; of overlapping ones the earliest, longest goes first."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def masked(spark: SparkSession, field: Field, text: Column) -> Column:
    """The masked text; a null text stays null, whatever other columns a row has."""
    shared = spark.sparkContext.broadcast(field)
    out = T.StructType([T.StructField("masked", T.StringType())])

    def start() -> Callable[[list[str | None]], list[list]]:
        return lambda texts: [[t if t is None else mask(t, all_spans(t, shared.value)[1]) for t in texts]]

    return from_text(text, out, start)["masked"]
