"""Language ID by word-first backoff: known words by their log frequency in each language, others by ever shorter character n-grams.

Words and n-grams stand in a model as 64-bit hashes in ascending order, so that it is a few arrays
of bounded size, looked up for a whole batch at once. Two of a million items share a hash with a
chance under 1 in 30 million.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import from_text, map_texts, release, slices

LONGEST = 4
UNKNOWN = "und"
ADDED = 0.1  # to each count
FLOOR = -12.0  # log frequency of a place at which no n-gram is known
_STEP, _MIX, _MIX2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def split_words(texts: pa.Array) -> pa.Array:
    """Lower-cased runs of letters of each text, as lists; those at a text's ends may be empty."""
    low = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    return pc.split_pattern(pc.replace_substring_regex(low, r"\P{L}+", " "), " ")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


@dataclass
class Marked:
    """The code points of words between a ^ and a $ each, in one row."""

    points: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, words: list[str]) -> Marked:
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
        line = "".join(f"^{w}$" for w in words)
        return cls(np.frombuffer(line.encode("utf-32-le"), "<u4").astype(np.uint64), np.cumsum(sizes) - sizes, sizes)

    def owners(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def word_keys(self) -> np.ndarray:
        """A hash of each word, from its characters with their places."""
        if not len(self.sizes):
            return np.zeros(0, np.uint64)
        place = (np.arange(len(self.points)) - np.repeat(self.starts, self.sizes)).astype(np.uint64)
        return _mixed(np.add.reduceat(_mixed(self.points + (place + np.uint64(1)) * _STEP), self.starts))

    def gram_keys(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each size the places at which an n-gram of it begins, and its hash; the markers alone are none."""
        left = np.repeat(self.starts + self.sizes, self.sizes) - np.arange(len(self.points))  # characters to the word's end
        key = np.zeros(len(self.points), np.uint64)
        for size in range(1, LONGEST + 1):
            ahead = np.zeros_like(self.points)
            ahead[: max(0, len(ahead) - size + 1)] = self.points[size - 1 :]
            key = _mixed(key + _STEP + ahead)
            inside = left >= size
            if size == 1:
                inside = inside & (self.points != ord("^")) & (self.points != ord("$"))
            at = np.flatnonzero(inside)
            yield size, at, key[at]


@dataclass
class Counts:
    """Items by ascending hash, each with the languages that have it and what its count adds to their log frequency.

    ``base`` is the log frequency of an item that a language doesn't have.
    """

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray
    base: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, langs: np.ndarray, n: np.ndarray, sums: np.ndarray) -> Counts:
        order = np.lexsort((langs, keys))
        unique, starts = np.unique(keys[order], return_index=True)
        base = np.log(ADDED / (sums + ADDED * max(1, len(unique))))
        return cls(unique, np.append(starts, len(keys)).astype(np.int32), langs[order].astype(np.int16), np.log1p(n[order] / ADDED).astype(np.float32), base)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, -1 if it isn't known."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, out: np.ndarray, rows: np.ndarray, at: np.ndarray) -> None:
        """Adds the log frequencies of known items to rows of ``out``, item by item in the order given."""
        n_langs = out.shape[1]
        width = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(width)
        pick = np.arange(width.sum()) - np.repeat(ends - width, width) + np.repeat(self.starts[at], width)
        flat = np.repeat(rows, width) * n_langs + self.langs[pick]
        out += np.bincount(flat, self.gains[pick].astype(float), out.size).reshape(out.shape)
        out += np.bincount(rows, minlength=len(out))[:, None] * self.base


@dataclass
class Model:
    """Counts of words, and of n-grams by size."""

    languages: list[str]
    words: Counts
    grams: list[Counts]

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word, a column for each language.

        An unknown word takes from each place the longest known n-gram that starts there; the mean
        of these counts double, so that a word of any length weighs about as much as a known one.
        """
        out = np.zeros((len(words), len(self.languages)))
        if not out.size:
            return out
        own = Marked.of(words)
        at = self.words.find(own.word_keys())
        known = np.flatnonzero(at >= 0)
        self.words.add(out, known, at[known])
        unknown = np.flatnonzero(at < 0)
        if len(unknown):
            out[unknown] = self.unseen(Marked.of([words[i] for i in unknown.tolist()]))
        return out

    def unseen(self, own: Marked) -> np.ndarray:
        total = np.zeros((len(own.sizes), len(self.languages)))
        owners = own.owners()
        free = np.ones(len(owners), bool)
        free[own.starts + own.sizes - 1] = False  # nothing starts at the last marker
        for (size, places, keys) in sorted(own.gram_keys(), key=lambda x: -x[0]):
            open_at = free[places]
            places, keys = places[open_at], keys[open_at]
            found = self.grams[size - 1].find(keys)
            hit = found >= 0
            self.grams[size - 1].add(total, owners[places[hit]], found[hit])
            free[places[hit]] = False
        total += FLOOR * np.bincount(owners[free], minlength=len(total))[:, None]
        return 2.0 * total / (own.sizes - 1)[:, None]


def fit(docs: DataFrame, text_col: str, lang_col: str, id_col: str, max_docs: int = 20_000) -> Model:
    """A model of the rows with a text and a language: all words and n-grams of a sample of about ``max_docs`` of them.

    The sample of labelled rows is chosen by a hash of the id and bounds the model, which keeps every
    word and n-gram of it, those seen once too. Rows without an id count as one with an empty id, and
    an id's repeated rows are all in the sample or none is. No rows give a model without languages.
    """
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = rows.select(id_col).count()
    share = min(1.0, max_docs / max(1, n))
    chosen = F.pmod(F.xxhash64(F.lit("langid"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0)
    sample = rows.filter(chosen).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1)):
            lists = split_words(batch.column(1))
            langs = batch.column(0).dictionary_encode()
            table = pa.table({"lang": langs.indices.take(pc.list_parent_indices(lists)), "item": lists.flatten()}).filter(pc.field("item") != "")
            for own in table.group_by(["lang", "item"], use_threads=False).aggregate([([], "count_all")]).to_batches():
                yield pa.RecordBatch.from_arrays([langs.dictionary.take(own.column("lang")), own.column("item").cast(pa.string()), own.column("count_all")], names=["lang", "item", "n"])
        release()

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).dictionary_encode()
            lang, n = langs.indices.to_numpy(), batch.column(2).to_numpy()
            own = Marked.of(batch.column(1).to_pylist())
            owners = own.owners()
            parts = [(0, np.arange(len(lang)), own.word_keys())]
            parts += [(size, owners[at], keys) for size, at, keys in own.gram_keys()]
            for size, of, keys in parts:
                table = pa.table({"lang": lang[of], "key": keys.view(np.int64), "n": n[of]}).group_by(["lang", "key"], use_threads=False).aggregate([("n", "sum")])
                for out in table.to_batches():
                    yield pa.RecordBatch.from_arrays([langs.dictionary.take(out.column("lang")), pa.array(np.full(out.num_rows, size, np.int32)), out.column("key"), out.column("n_sum")], names=["lang", "size", "key", "n"])
        release()

    words = sample.mapInArrow(words_of, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n"))
    table = words.mapInArrow(keys_of, "lang string, size int, key long, n long").groupBy("lang", "size", "key").agg(F.sum("n").alias("n")).toArrow()
    coded = table.column("lang").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    languages = sorted(names)
    place = np.array([languages.index(x) for x in names], np.int64)
    lang = place[coded.indices.to_numpy()] if names else np.zeros(0, np.int64)
    size, key, n = (table.column(c).to_numpy() for c in ("size", "key", "n"))

    def counts(of: int) -> Counts:
        own = size == of
        return Counts.of(key[own].view(np.uint64), lang[own], n[own], np.bincount(lang[own], n[own], len(languages)))

    return Model(languages, counts(0), [counts(k) for k in range(1, LONGEST + 1)])


def predictor(model: Model) -> Callable[[pa.Array], list[list]]:
    """Predictions for an array of texts; each depends on its own text alone."""
    n_langs = len(model.languages)

    def predict(texts: pa.Array) -> list[list]:
        lists = split_words(texts)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        real = np.array([bool(w) for w in words], bool)
        at, owner = coded.indices.to_numpy(), pc.list_parent_indices(lists).to_numpy()
        owner, at = owner[real[at]], at[real[at]]
        n = np.bincount(owner, minlength=len(texts))
        rows = model.scores(words)
        total = np.stack([np.bincount(owner, rows[at, k], len(texts)) for k in range(n_langs)], axis=1) if n_langs else np.zeros((len(texts), 0))
        langs, sure = [], []
        for k, own in zip(n.tolist(), total, strict=True):
            if not k or not n_langs:
                langs.append(UNKNOWN)
                sure.append(0.0)
                continue
            best = int(np.argmax(own))
            langs.append(model.languages[best])
            sure.append(float(1 / np.exp((own - own[best]) / np.sqrt(k)).sum()))
        return [langs, sure]

    return predict


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def identify(docs: DataFrame, model: Model, keep: list[str | Column], text_col: str = "text", prefix: str = "") -> DataFrame:
    """``keep`` columns of every row with ``<prefix>lang_pred`` and ``<prefix>score``, from its whole text alone.

    The score is the share of the predicted language among all, with log scores divided by the
    square root of the number of words. A null text, one without letters, and any text under a
    model without languages are ``und`` with score 0. Equal scores go to the language first in
    order. Repeated rows give equal rows; an empty table gives none.
    """
    fields = T.StructType([T.StructField(prefix + f.name, f.dataType) for f in FIELDS])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample that fit took
    return map_texts(docs, text_col, keep, fields, lambda: predictor(shared.value), kind="array")


def predicted(spark: SparkSession, model: Model, text: Column) -> Column:
    """The same as a struct of ``lang_pred`` and ``score``, beside whatever columns a row has."""
    shared = spark.sparkContext.broadcast(model)
    return from_text(text, FIELDS, lambda: predictor(shared.value), kind="array")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from fitting: CRC-32 of the id as text leaves 2 when divided by 4; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2
