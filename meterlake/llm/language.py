"""Language identification by averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed character n-grams (orders 1 to 4 over letters and word edges),
then one linear layer and a softmax; both are trained by stochastic gradient descent in numpy. Training takes a bounded
sample (parameters of sample()): of the MOST_LANGUAGES most frequent languages some SAMPLE_ROWS rows each, MOST_ROWS in
all, and of longer texts PIECES pieces of SAMPLE_CHARS code points together, from the whole length of the text. A second,
disjoint part of the labelled rows, as bounded, sets the temperature and, for texts of each class of length, the
probability below which a prediction is rejected: that of the least sure MAY_REJECT of the rightly classified rows, and
MOST_BOUND at most, so a text of a language that was never learned is rejected unless it is short. Prediction reads whole
texts, batch by batch, from a table that is the product of embeddings and layer (orders x buckets x languages).

Edge cases: null text or a text without any letter is 'und' with score 0 and rejected; with no labelled row, every
text is 'und'; with one language, texts with letters get it; repeated rows give repeated results; extra columns are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlake.llm.common import short_batches, table, unused
from meterlake.session import written

SAMPLE_ROWS, SAMPLE_CHARS, PIECES = 1500, 2000, 4
MOST_ROWS, MOST_LANGUAGES = 12_000, 500
BUCKETS, WIDTH, ORDERS = 1 << 14, 16, (1, 2, 3, 4)
EPOCHS, BATCH, RATE = 6, 32, 0.5
#: Of the labelled rows that the model gets right, at most this share is rejected.
MAY_REJECT = 0.002
#: Rejection never asks for more than this probability.
MOST_BOUND = 0.8
#: Letters at which the classes of length begin, and rows that a class needs for a bound of its own.
CLASSES, CLASS_ROWS = (0, 50, 200, 1000), 100
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    weights: np.ndarray  # len(ORDERS) * BUCKETS rows, one column per language
    bias: np.ndarray
    temperature: float
    bounds: np.ndarray  # one for each class of length


def code_points(text: str) -> np.ndarray:
    """Lower-case letters with one space for every run of anything else, and a space at both ends."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = is_letter()[np.minimum(c, 0x10FFFF)]
    c = np.where(letter, c, np.uint32(32))
    keep = np.ones(len(c), bool)
    keep[1:] = letter[1:] | letter[:-1]
    edge = np.array([32], np.uint32)
    return np.concatenate([edge, c[keep], edge])


_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def grams(points: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of the table for the n-grams of each order."""
    h = np.zeros(len(points), np.uint32)
    for k, n in enumerate(ORDERS):
        h = h[: max(0, len(points) - n + 1)] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1)
        mixed = h ^ (h >> np.uint32(15))
        yield (mixed * np.uint32(0x85EBCA6B) >> np.uint32(32 - BUCKETS.bit_length() + 1)).astype(np.int64) + k * BUCKETS


class Features(NamedTuple):
    """Rows of the table and their counts for all texts, one after the other; bounds parts the texts."""

    rows: np.ndarray
    counts: np.ndarray
    bounds: np.ndarray

    def of(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, shares of each text's mean, and where the texts begin."""
        at = [slice(self.bounds[i], self.bounds[i + 1]) for i in some]
        rows, counts = (np.concatenate([x[s] for s in at]) for x in (self.rows, self.counts))
        starts = np.cumsum([0, *(s.stop - s.start for s in at[:-1])])
        total = np.add.reduceat(counts, starts, dtype=np.float32)
        share = counts.astype(np.float32) / np.repeat(total, [s.stop - s.start for s in at])
        return rows.astype(np.int64), share, starts


def features(texts: list[str]) -> Features:
    """In narrow types and few arrays, for this is what the fit holds in memory."""
    rows, counts, sizes = [], [], [0]
    for at in range(0, len(texts), 200):
        parts = [np.unique(np.concatenate(list(grams(code_points(t)))), return_counts=True) for t in texts[at : at + 200]]
        rows.append(np.concatenate([p[0] for p in parts]).astype(np.uint16))
        counts.append(np.concatenate([p[1] for p in parts]).astype(np.uint32))
        sizes += [len(p[0]) for p in parts]
    return Features(np.concatenate(rows), np.concatenate(counts), np.cumsum(sizes))


def fit(texts: list[str], labels: list[str], seed: int = 7) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, and the table and bias that give their logits."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    x, n = features(texts), len(texts)
    y = np.array([languages.index(v) for v in labels])
    emb = rng.normal(0, 0.1, (len(ORDERS) * BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    layer += rng.normal(0, 0.3, layer.shape)
    steps = EPOCHS * -(-n // BATCH)
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(n)
        for i in range(0, n, BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            some = order[i : i + BATCH]
            rows, share, starts = x.of(some)
            mean = np.add.reduceat(emb[rows] * share[:, None], starts)
            logits = mean @ layer + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            back = p @ layer.T
            layer -= rate * mean.T @ p
            bias -= rate * p.sum(0) / len(some)
            # An n-gram's step is scaled by its share; rare grams keep a useful rate by the square root.
            per = np.repeat(back, np.diff([*starts, len(rows)]), axis=0) * np.sqrt(share)[:, None]
            np.subtract.at(emb, rows, rate * per)
    return languages, (emb @ layer).astype(np.float32), bias


def logits(texts: list[str], weights: np.ndarray, bias: np.ndarray, at_once: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """One row of logits for each text, whole texts in one pass for each order; and how many letters each has."""
    if len(texts) > at_once:
        parts = [logits(texts[i : i + at_once], weights, bias) for i in range(0, len(texts), at_once)]
        return np.concatenate([z for z, _ in parts]), np.concatenate([n for _, n in parts])
    points = [code_points(t) for t in texts]
    out = np.zeros((len(texts), len(bias)))
    total = np.zeros(len(texts))
    for k in range(len(ORDERS)):
        rows = []
        for p in points:
            rows.append(_gram(p, k))
        n = np.array([len(r) for r in rows])
        full = n > 0
        if full.any():
            flat = np.concatenate(rows)
            starts = np.cumsum(n[full]) - n[full]
            for j in range(len(bias)):
                out[full, j] += np.add.reduceat(weights[:, j][flat], starts, dtype=np.float64)
        total += n
    return out / np.maximum(total, 1)[:, None] + bias, np.array([int((p != 32).sum()) for p in points], int)


def _gram(points: np.ndarray, k: int) -> np.ndarray:
    for i, rows in enumerate(grams(points)):
        if i == k:
            return rows
    raise IndexError(k)


def softmax(z: np.ndarray, temperature: float) -> np.ndarray:
    e = np.exp((z - z.max(1, keepdims=True)) / temperature)
    return e / e.sum(1, keepdims=True)


def foreign(text: str) -> str:
    """The text with every letter moved to where no n-gram of it was learned: what should not be recognised."""
    return "".join(chr((ord(c) + 0x3000) % 0xD000) if c.isalpha() else c for c in text)


def length_class(letters: np.ndarray) -> np.ndarray:
    return np.searchsorted(CLASSES, letters, side="right") - 1


def calibrate(z: np.ndarray, y: np.ndarray, letters: np.ndarray, other: np.ndarray) -> tuple[float, np.ndarray]:
    """The temperature, and for each class of length the bound below which a prediction is rejected.

    The temperature minimises the log loss of known rows plus that of foreign ones against no preference. A class with
    few rows has the bound of all rows together.
    """
    grid = np.geomspace(0.05, 10, 60)
    known = [-np.log(softmax(z, t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    unknown = [-np.log(softmax(other, t) + 1e-12).mean() for t in grid]
    t = float(grid[int(np.argmin(np.add(known, unknown)))])
    p = softmax(z, t)
    right, classes = p.argmax(1) == y, length_class(letters)
    bounds = np.zeros(len(CLASSES))
    for c in range(len(CLASSES)):
        own = right & (classes == c)
        own = own if own.sum() >= CLASS_ROWS else right
        if own.any():
            bounds[c] = min(MOST_BOUND, np.quantile(p[own].max(1), MAY_REJECT))
    return t, bounds


def fold() -> Column:
    """The part of the labelled rows that a document is in: 2 is never learned from, 3 calibrates."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))


def sample(docs: DataFrame, most_rows: int = SAMPLE_ROWS, most_chars: int = SAMPLE_CHARS, most_all: int = MOST_ROWS, most_languages: int = MOST_LANGUAGES) -> pd.DataFrame:
    """Some most_rows rows of each language and role, by a hash of the row, most_all in all: text, lang, held."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != 2)).select("text", "lang", (fold() == 3).alias("held"), F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang", "held").count()
    top = counts.groupBy("lang").agg(F.sum("count").alias("all")).orderBy(F.desc("all"), "lang").limit(most_languages)
    # At most two lines for each of the languages that are kept: few enough for a broadcast.
    counts = written(counts.join(top.select("lang"), "lang", "left_semi"), "languages")
    groups = max(1, counts.count())
    step = F.ceil(F.col("count") / F.lit(max(1, min(most_rows, most_all // groups))))
    part = rows.join(F.broadcast(counts), ["lang", "held"]).where(F.pmod("h", step) == 0)
    size, n = most_chars // PIECES, F.length("text")
    pieces = F.concat_ws(" ", *(F.substring("text", (1 + F.floor((n - size) * i / (PIECES - 1))).cast("int"), F.lit(size)) for i in range(PIECES)))
    found = part.select(F.when(n > most_chars, pieces).otherwise(F.col("text")).alias("text"), "lang", "held").toPandas()
    return found.sort_values(["lang", "held", "text"], ignore_index=True)


def train(docs: DataFrame) -> Model:
    """A model from the labelled rows of documents outside the held-out part."""
    rows = sample(docs)
    rows = rows[[any(c.isalpha() for c in t) for t in rows["text"]]] if len(rows) else rows
    own, rest = (rows[~rows["held"]], rows[rows["held"]]) if len(rows) else (rows, rows)
    own = own if len(own) else rest
    if not len(own):
        return Model([], np.zeros((len(ORDERS) * BUCKETS, 0), np.float32), np.zeros(0, np.float32), 1.0, np.zeros(len(CLASSES)))
    languages, weights, bias = fit(own["text"].tolist(), own["lang"].tolist())
    rest = rest[rest["lang"].isin(languages)]
    if not len(rest):
        return Model(languages, weights, bias, 1.0, np.zeros(len(CLASSES)))
    y = np.array([languages.index(v) for v in rest["lang"]], int)
    texts = rest["text"].tolist()
    z, letters = logits(texts, weights, bias)
    other, _ = logits([foreign(t) for t in texts], weights, bias)
    return Model(languages, weights, bias, *calibrate(z, y, letters, other))


def classify(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, probability and acceptance of each text."""
    lettered = np.array([bool(t) and any(c.isalpha() for c in t) for t in texts], bool)
    if not model.languages or not lettered.any():
        return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
    score, best, bound = np.zeros(len(texts)), np.zeros(len(texts), int), np.zeros(len(texts))
    z, letters = logits([t for t, x in zip(texts, lettered, strict=True) if x], model.weights, model.bias)
    p = softmax(z, model.temperature)
    score[lettered], best[lettered], bound[lettered] = p.max(1), p.argmax(1), model.bounds[length_class(letters)]
    return [model.languages[i] if x else UNKNOWN for i, x in zip(best, lettered, strict=True)], score, lettered & (score >= bound)


def found(docs: DataFrame, model: Model, into: str) -> DataFrame:
    """docs and one more column: lang_pred, score and accepted of its text."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [classify(batch.iloc[at : at + 200].tolist(), held.value) for at in range(0, len(batch), 200)]
            lang, score, accepted = zip(*parts, strict=True) if parts else ((), (), ())
            yield pd.DataFrame({"lang_pred": [x for p in lang for x in p], "score": [x for p in score for x in p], "accepted": [bool(x) for p in accepted for x in p]})

    return short_batches(docs).withColumn(into, run("text"))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The same columns of docs and lang_pred, score, accepted (columns of these names are replaced)."""
    into = unused(docs, "found")
    return found(docs, model, into).withColumns({c: F.col(into)[c] for c in ("lang_pred", "score", "accepted")}).drop(into)


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose language is accepted, columns as they are; none where nothing was learned."""
    into = unused(docs, "found")
    return found(docs, model, into).where(F.col(into)["accepted"]).drop(into)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold() == 2).alias("held_out"), "text")
    return predict(rows, train(docs)).drop("text")
