"""Quality scores by co-training: a classifier of the text and one of the page's metadata teach each other.

Features of all documents are made once, sparse, and kept as a table. In each round both views
are trained on what they know, score every document, and hand the ones they are surest of, by
class, to the other view. Only those come to the driver. A label that is handed over weighs as
much as the view that gave it is sure of it, so that a weak view can't drown a strong one.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..runtime import cut, forget
from .arrow import release, slices

WORDS, SHAPES, LAYOUT = 1024, 256, 16
TEXT_DIMS = WORDS + SHAPES + LAYOUT
# The number of hashed places of host, language, size, and their pairs.
META = (64, 32, 32, 256, 512, 128)
META_DIMS = sum(META)
LEAST_SURE = 0.55  # of a class, with both classes alike
_LETTERS, _DIGITS, _RUN = re.compile(r"[^\W\d_]+"), re.compile(r"\d+"), re.compile(r"(.)\1+")


def shape(token: str) -> str:
    """A token with its letters and digits by kind and repeats collapsed."""
    return _RUN.sub(r"\1", _DIGITS.sub("9", _LETTERS.sub("A" if token.isupper() else "a", token)))


def bucket(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass")) % size


class TextView:
    """Features of whole texts: shares of tokens by hashed word and hashed shape, and layout."""

    def __init__(self, limit: int = 100_000):
        self.kept: dict[str, tuple[int, int]] = {}
        self.limit = limit

    @staticmethod
    def layout(text: str | None, n_tokens: int) -> tuple[int, int]:
        """Two places: eighths of the lines that repeat an earlier one, and of the logarithm of the mean line's tokens."""
        lines = [s for s in (text or "").split("\n") if s]
        repeated = 1 - len(set(lines)) / len(lines) if lines else 0.0
        return WORDS + SHAPES + min(7, int(8 * repeated)), WORDS + SHAPES + 8 + min(7, int(np.log2(1 + n_tokens / max(1, len(lines)))))

    def features(self, texts: pa.Array) -> Sparse:
        """A row for each text. A null or empty text has one empty token."""
        if len(self.kept) > self.limit:
            self.kept.clear()
        lists = pc.split_pattern(pc.replace_substring_regex(pc.fill_null(texts, "").cast(pa.large_string()), r"\s+", " "), " ")
        coded = lists.flatten().dictionary_encode()
        pairs = np.zeros((len(coded.dictionary), 2), np.int64)
        for i, token in enumerate(coded.dictionary.to_pylist()):
            own = self.kept.get(token)
            if own is None:
                own = self.kept[token] = (bucket(token.lower(), WORDS), WORDS + bucket(shape(token), SHAPES))
            pairs[i] = own
        at, n = coded.indices.to_numpy(), np.diff(lists.offsets.to_numpy())
        row = np.repeat(np.arange(len(n)) * TEXT_DIMS, n)
        flat, counts = np.unique(np.concatenate((row + pairs[at, 0], row + pairs[at, 1])), return_counts=True)
        more = np.array([self.layout(t, k) for t, k in zip(texts.to_pylist(), n.tolist(), strict=True)], np.int64).reshape(-1, 2)
        flat = np.concatenate((flat, (more + np.arange(len(n))[:, None] * TEXT_DIMS).ravel()))
        values = np.concatenate((counts / np.maximum(1, n)[flat[: len(counts)] // TEXT_DIMS], np.ones(more.size)))
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        return Sparse(np.searchsorted(flat, np.arange(len(n) + 1) * TEXT_DIMS), (flat % TEXT_DIMS).astype("<u2"), values[order].astype("<f2"))


@dataclass
class Sparse:
    """Rows of places and values; each row has some."""

    starts: np.ndarray
    places: np.ndarray
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.starts) - 1

    def packed(self) -> list[bytes]:
        return [self.places[a:b].tobytes() + self.values[a:b].tobytes() for a, b in zip(self.starts, self.starts[1:])]

    @classmethod
    def unpacked(cls, rows: list[bytes]) -> Sparse:
        halves = [(r[: len(r) // 2], r[len(r) // 2 :]) for r in rows]
        starts = np.concatenate(([0], np.cumsum([len(a) // 2 for a, _ in halves]))).astype(np.int64)
        return cls(starts, np.frombuffer(b"".join(a for a, _ in halves), "<u2"), np.frombuffer(b"".join(b for _, b in halves), "<f2"))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """The product with weights; each row's sum is made in the order of its places, whatever rows are beside it."""
        owner = np.repeat(np.arange(len(self)), np.diff(self.starts))
        return np.bincount(owner, weights[self.places] * self.values.astype(float), len(self))

    def dense(self, dims: int) -> np.ndarray:
        out = np.zeros((len(self), dims), np.float32)
        out[np.repeat(np.arange(len(self)), np.diff(self.starts)), self.places] = self.values
        return out


def meta_places(host: str | None, lang: str | None, size: int | None) -> list[int]:
    """The features of a page's metadata: host, language, size by powers of two, and each two of them."""
    n = 0 if size is None or size < 1 else min(31, int(size).bit_length())
    parts = (host or "", lang or "", str(n))
    keys = [*parts, "|".join(parts[:2]), f"{parts[0]}|{n}", f"{parts[1]}|{n}"]
    out, start = [], 0
    for i, (key, dims) in enumerate(zip(keys, META, strict=True)):
        out.append(start + (n if i == 2 else bucket(key, dims)))
        start += dims
    return out


@dataclass
class Linear:
    weights: np.ndarray
    bias: float


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-2, steps: int = 300, rate: float = 4.0) -> Linear:
    """Logistic regression by gradient steps with momentum; rows count by ``weight``, each class half."""
    x, up = x.astype(np.float32), y > 0.5
    own = weight * np.where(up, 0.5 / max(1e-9, weight[up].sum()), 0.5 / max(1e-9, weight[~up].sum()))
    scale = 1.0 / np.maximum(1e-3, np.sqrt((own[:, None] * x**2).sum(0)))
    z = (x * scale).astype(np.float32)
    w, b, mw, mb = np.zeros(x.shape[1]), 0.0, np.zeros(x.shape[1]), 0.0
    rate = rate / max(1.0, float((z**2).sum(1).mean()))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w.astype(np.float32) + b, -30, 30)))
        g = own * (p - y)
        mw, mb = 0.9 * mw + z.T @ g.astype(np.float32) + penalty * w, 0.9 * mb + g.sum()
        w, b = w - rate * mw, b - rate * mb
    return Linear(w * scale, float(b))


def platt(z: np.ndarray, y: np.ndarray, even: bool = False, steps: int = 60) -> np.ndarray:
    """Slopes and an intercept of a logistic fit by Newton steps with a small penalty; z has a column for each slope. ``even`` gives each class half."""
    x = np.column_stack([z, np.ones(len(z))])
    own = len(y) * np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum())) if even else np.ones(len(y))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (own * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w += np.clip(np.linalg.solve(h, x.T @ (own * (y - p)) - 0.05 * w), -2, 2)
    return w


@dataclass
class Model:
    """Both views, their calibration (slope, intercept), the weights that combine calibrated logits, and the labels each round gave (to text, to metadata)."""

    text: Linear
    meta: Linear
    calibration: np.ndarray
    mixture: np.ndarray
    rounds: list[tuple[int, int]]

    def logits(self, text: Sparse, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return text.dot(self.text.weights) + self.text.bias, self.meta.weights[meta].sum(1) + self.meta.bias

    def combine(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.calibration[0, 0] * text + self.calibration[0, 1]
        b = self.calibration[1, 0] * meta + self.calibration[1, 1]
        both = self.mixture[0] * a + self.mixture[1] * b + self.mixture[2]
        return tuple(1 / (1 + np.exp(-np.clip(v, -30, 30))) for v in (a, b, both))


@dataclass
class Known:
    """Rows that a view is trained on: features of both views, labels and weights by id."""

    text: dict[str, bytes]
    meta: dict[str, list[int]]
    labels: tuple[dict[str, tuple[float, float]], dict[str, tuple[float, float]]]
    held: dict[str, float]

    def matrix(self, view: int, ids: list[str]) -> np.ndarray:
        if not view:
            return Sparse.unpacked([self.text[i] for i in ids]).dense(TEXT_DIMS)
        out = np.zeros((len(ids), META_DIMS), np.float32)
        np.put_along_axis(out, np.array([self.meta[i] for i in ids]), 1, axis=1)
        return out

    def models(self, rounds: list[tuple[int, int]], even: bool) -> Model:
        """Both views trained on what they know, and calibrated on the rows that are held for it."""
        views, logits = [], []
        held = sorted(self.held)
        y = np.array([self.held[i] for i in held])
        for v in (0, 1):
            ids = sorted(self.labels[v])
            own = np.array([self.labels[v][i] for i in ids])
            views.append(logistic(self.matrix(v, ids), own[:, 0], own[:, 1]))
            logits.append(self.matrix(v, held).astype(float) @ views[v].weights + views[v].bias)
        cal = np.stack([platt(z[:, None], y, even) for z in logits])
        mixture = platt(np.column_stack([cal[v, 0] * logits[v] + cal[v, 1] for v in (0, 1)]), y, even)
        return Model(*views, cal, mixture, rounds)


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars") -> DataFrame:
    """(id, text, meta) of every row: its id as it is, the packed text features, and the places of the metadata."""
    shape_of = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("text", T.BinaryType()), T.StructField("meta", T.ArrayType(T.IntegerType()))])
    out = to_arrow_schema(shape_of)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        view = TextView()
        for batch in (part for whole in batches for part in slices(whole, 1)):
            metas = [meta_places(*m) for m in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(view.features(batch.column(1)).packed(), pa.binary()), pa.array(metas, out.field("meta").type)], schema=out)
        del view
        release()

    return docs.select(id_col, text_col, host_col, lang_col, size_col).mapInArrow(work, shape_of)


def surest(table: DataFrame, model: Model, known: set[str], grow: int) -> list:
    """For each view and class the ``grow`` rows of the table that the view is surest of, beside known ids; ties by id.

    Each task keeps its own best, and only the best of these come to the driver.
    """
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast((model, known))  # two linear models, and ids of rows that the driver has
    shape_of = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("p", T.DoubleType()), T.StructField("id", T.StringType()), T.StructField("text", T.BinaryType()), T.StructField("meta", T.ArrayType(T.IntegerType()))])
    out = to_arrow_schema(shape_of)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, seen = shared.value
        best: list[dict[str, tuple]] = [{} for _ in range(4)]
        for batch in batches:
            texts, metas = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            if not texts:
                continue
            p = own.combine(*own.logits(Sparse.unpacked(texts), np.array(metas)))[:2]
            ids = batch.column(0).to_pylist()
            for k in range(4):
                sure = p[k // 2] if k % 2 else 1 - p[k // 2]
                floor = min((x[0] for x in best[k].values()), default=0.0) if len(best[k]) >= grow else LEAST_SURE
                for i in np.flatnonzero(sure >= max(floor, LEAST_SURE)).tolist():
                    if ids[i] is not None and str(ids[i]) not in seen:
                        best[k].setdefault(str(ids[i]), (float(sure[i]), texts[i], metas[i]))
                if len(best[k]) > grow:
                    best[k] = {i: best[k][i] for i in heapq.nsmallest(grow, best[k], key=lambda i: (-best[k][i][0], i))}
        rows = [(k, p, i, t, m) for k, own in enumerate(best) for i, (p, t, m) in own.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)
        release()

    found = cut(table.mapInArrow(work, shape_of))
    rows = [found.filter(F.col("list") == k).orderBy(F.desc("p"), "id", "text", "meta").limit(grow).collect() for k in range(4)]
    forget(found)
    return rows


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", max_labelled: int = 4000, rounds: int = 4, grow: int = 150, made: DataFrame | None = None, **columns: str) -> Model | None:
    """A model from about ``max_labelled`` labelled documents and all the others as the pool.

    The labelled rows, half of each class as far as there are, are those of the least hashes of
    their ids; a quarter of them is held for calibration (all are, where a class has under four).
    In each round each view gives the other up to ``grow`` rows of each class. Without labels of
    both kinds there is no model. An id with several labels takes the largest, one with several
    rows the least of their features; null labels and ids don't count. ``made`` has the features of
    the documents, if they are made already.
    """
    marks = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_y"))
    order = F.xxhash64(F.lit("labelled"), F.col("_id").cast("string"))
    chosen = [marks.filter(F.col("_y") == y).orderBy(order, "_id").limit(max_labelled // 2) for y in (0, 1)]
    table = cut(features(docs, id_col, **columns)) if made is None else made
    # at most max_labelled rows of two numbers
    joined = table.join(F.broadcast(cut(chosen[0].union(chosen[1]))), F.col("id") == F.col("_id")).groupBy("id", "_y").agg(F.min(F.struct("text", "meta")).alias("x"))
    got = sorted(joined.select(F.col("id").cast("string").alias("id"), "_y", "x.*").collect(), key=lambda r: (zlib.crc32(r["id"].encode()), r["id"]))
    by_class = [[r for r in got if r["_y"] == y] for y in (0, 1)]
    if not all(by_class):
        return None
    few = min(map(len, by_class)) < 4
    held = {r["id"]: float(r["_y"]) for own in by_class for k, r in enumerate(own) if few or k % 4 == 0}
    learn = {r["id"]: (float(r["_y"]), 1.0) for own in by_class for k, r in enumerate(own) if few or k % 4}
    known = Known({r["id"]: r["text"] for r in got}, {r["id"]: list(r["meta"]) for r in got}, (dict(learn), dict(learn)), held)
    log: list[tuple[int, int]] = []
    for _ in range(rounds):
        lists = surest(table, known.models(log, even=True), set(known.text), grow)
        for k, rows in enumerate(lists):
            for r in rows:
                known.text[r["id"]], known.meta[r["id"]] = r["text"], list(r["meta"])
                known.labels[1 - k // 2].setdefault(r["id"], (float(k % 2), 2 * r["p"] - 1))
        log.append((sum(map(len, lists[2:])), sum(map(len, lists[:2]))))
        if not any(log[-1]):
            break
    return known.models(log, even=False)


FIELDS = T.StructType([T.StructField(n, T.DoubleType()) for n in ("p_text", "p_meta", "score")])


def score(table: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, p_text, p_meta, score of every row of a table of features: the calibrated probability of good quality of each view and of both.

    Null and empty texts have one empty token; null metadata count as an empty host or language,
    or size 0. Without a model all are 0.5. Repeated rows give equal rows; an empty table none.
    """
    shared = table.sparkSession.sparkContext.broadcast(model)  # under 3,000 numbers
    schema = T.StructType([T.StructField("doc_id", table.schema["id"].dataType), *FIELDS.fields])
    out = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            if m is None or not batch.num_rows:
                p = [np.full(batch.num_rows, 0.5)] * 3
            else:
                p = m.combine(*m.logits(Sparse.unpacked(batch.column(1).to_pylist()), np.array(batch.column(2).to_pylist())))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in p)], schema=out)

    return table.select("id", "text", "meta").mapInArrow(work, schema)
