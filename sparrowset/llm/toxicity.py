"""Toxicity: a convolutional text classifier over hashed words, trained in numpy on the driver.

A word is the sum of two hashed embeddings, of itself and of its first letters. Filters of several widths run over the
words; each filter's largest value in the text goes to a logistic output. Thresholds are calibrated for each language
on labelled rows that were not trained on.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparrowset.llm.common import checkpointed, fresh, text_of

WORD = re.compile(r"[^\W\d_]+")
BUCKETS = 1 << 15
PREFIX = 4
DIM = 16
WIDTHS = (1, 2, 3)
FILTERS = 16
#: Labelled rows that are used at most, chosen by a hash of the id: positive ones and others.
MAX_POSITIVE = 1500
MAX_NEGATIVE = 3000
#: Of their texts, in the order of that hash, as many as have so many characters together; a text that doesn't fit any
#: more is left out whole.
MAX_CHARS = 100_000_000
EPOCHS = 6
BATCH = 32
#: The share of a text's words that a training step leaves out, drawn anew each time, so that no score hangs on one word.
DROP = 0.2
#: Models trained from different beginnings, of which the one that fits the calibration rows best is used.
RESTARTS = 3
#: Words that go through the filters at once when a text is scored.
CHUNK = 1 << 14
PAD = 0


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 when divided by 4; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


class _Ids(dict):
    """word -> the hash of the word in the high half, that of its first letters in the low half; bounded."""

    def __missing__(self, word: str) -> int:
        value = (1 + crc32(word.encode()) % (BUCKETS - 1)) << 32 | (1 + crc32(b"^" + word[:PREFIX].encode()) % (BUCKETS - 1))
        if len(self) >= 500_000:
            self.clear()
        self[word] = value
        return value


@lru_cache(maxsize=1)
def _ids() -> _Ids:
    return _Ids()


def word_ids(text: str | None) -> np.ndarray:
    """n x 2 bucket numbers of the words of the whole lower-cased text; empty texts have none."""
    words = WORD.findall((text or "").lower())
    both = np.fromiter(map(_ids().__getitem__, words), np.int64, len(words))
    return np.stack([both >> 32, both & 0xFFFFFFFF], 1)


@dataclass
class Model:
    embed: np.ndarray  # 2 x BUCKETS x DIM; bucket PAD stays zero
    filters: list[np.ndarray]  # for each width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    thresholds: dict[str, float] = field(default_factory=dict)
    default_threshold: float = 0.3

    def vectors(self, ids: np.ndarray) -> np.ndarray:
        return self.embed[0][ids[:, 0]] + self.embed[1][ids[:, 1]]

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width, positions x FILTERS of the padded words x."""
        return [sum(x[j : len(x) - w + 1 + j] @ f[j] for j in range(w)) for w, f in zip(WIDTHS, self.filters, strict=True)]

    def pooled(self, ids: np.ndarray) -> np.ndarray:
        """The largest response of each filter over the whole text, in chunks that overlap by a filter's width."""
        ids = padded(ids)
        most = None
        for s in range(0, len(ids) - max(WIDTHS) + 1, CHUNK):
            now = np.concatenate([r.max(0) for r in self.responses(self.vectors(ids[s : s + CHUNK + max(WIDTHS) - 1]))])
            most = now if most is None else np.maximum(most, now)
        return most

    def score_ids(self, ids: np.ndarray) -> float:
        z = np.maximum(self.pooled(ids) + self.bias, 0) @ self.out + self.out_bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, text: str | None) -> float:
        """0 to 1; a text without words is padding alone and gets the score of that."""
        return self.score_ids(word_ids(text))


def padded(ids: np.ndarray) -> np.ndarray:
    edge = np.full((max(WIDTHS) - 1, 2), PAD, ids.dtype)
    return np.concatenate([edge, ids, edge])


class _Adam:
    def __init__(self, shape, rate: float):
        self.m, self.v, self.rate, self.t = np.zeros(shape, np.float32), np.zeros(shape, np.float32), rate, 0

    def step(self, value: np.ndarray, grad: np.ndarray, rows=...) -> None:
        self.t += 1
        self.m[rows] = 0.9 * self.m[rows] + 0.1 * grad
        self.v[rows] = 0.99 * self.v[rows] + 0.01 * grad * grad
        value[rows] -= self.rate * (self.m[rows] / (1 - 0.9**self.t)) / (np.sqrt(self.v[rows] / (1 - 0.99**self.t)) + 1e-6)


def loss_and_gradients(model: Model, docs: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[float, dict]:
    """The weighted logistic loss of padded documents and its gradients: "f0", "f1" ... (filters), "b", "o", "ob", and
    "e0", "e1" as (rows, their gradients). Only the positions that win the pooling get gradients."""
    kind = model.out.dtype
    rows0, rows1, grads = [], [], []
    out: dict = {f"f{k}": np.zeros_like(f) for k, f in enumerate(model.filters)}
    out |= {"b": np.zeros_like(model.bias), "o": np.zeros_like(model.out), "ob": np.zeros(1, kind)}
    norm, loss = weights.sum(), 0.0
    for ids, label, weight in zip(docs, labels, weights, strict=True):
        x = model.vectors(ids)
        resp = model.responses(x)
        where = [r.argmax(0) for r in resp]
        top = np.concatenate([r[i, np.arange(FILTERS)] for r, i in zip(resp, where, strict=True)]) + model.bias
        act = np.maximum(top, 0)
        z = np.clip(act @ model.out + model.out_bias, -30, 30)
        loss += (np.log1p(np.exp(z)) - label * z) * weight / norm
        g = ((1 / (1 + np.exp(-z)) - label) * weight / norm).astype(kind)
        out["o"] += g * act
        out["ob"] += g
        g_top = g * model.out * (top > 0)
        out["b"] += g_top
        for k, (w, i) in enumerate(zip(WIDTHS, where, strict=True)):
            own = g_top[k * FILTERS : (k + 1) * FILTERS]
            for j in range(w):
                out[f"f{k}"][j] += x[i + j].T * own
                rows0.append(ids[i + j, 0])
                rows1.append(ids[i + j, 1])
                grads.append((model.filters[k][j] * own).T)
    g_x = np.concatenate(grads)
    for name, rows in (("e0", rows0), ("e1", rows1)):
        used, inverse = np.unique(np.concatenate(rows), return_inverse=True)
        total = np.zeros((len(used), DIM), kind)
        np.add.at(total, inverse, g_x)
        total[used == PAD] = 0  # padding stays zero
        out[name] = (used, total)
    return float(loss), out


def new_model(seed: int = 7) -> Model:
    rng = np.random.default_rng(seed)
    model = Model(
        (rng.standard_normal((2, BUCKETS, DIM)) * 0.1).astype(np.float32),
        [(rng.standard_normal((w, DIM, FILTERS)) * np.sqrt(1 / (w * DIM))).astype(np.float32) for w in WIDTHS],
        np.zeros(len(WIDTHS) * FILTERS, np.float32),
        (rng.standard_normal(len(WIDTHS) * FILTERS) * 0.3).astype(np.float32),
        0.0,
    )
    model.embed[:, PAD] = 0
    return model


def train(texts_ids: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """Weighted logistic loss by Adam, on texts without a random share DROP of their words."""
    model, rng = new_model(seed), np.random.default_rng(seed + 1)
    own = {"b": model.bias, "o": model.out, "ob": np.zeros(1, np.float32)} | {f"f{k}": f for k, f in enumerate(model.filters)}
    opt = {k: _Adam(v.shape, 0.01) for k, v in own.items()} | {k: _Adam((BUCKETS, DIM), 0.02) for k in ("e0", "e1")}
    for _ in range(epochs if texts_ids else 0):
        order = rng.permutation(len(texts_ids))
        for s in range(0, len(order), BATCH):
            at = order[s : s + BATCH]
            docs = [padded(texts_ids[d][rng.random(len(texts_ids[d])) >= DROP]) for d in at]
            _, grads = loss_and_gradients(model, docs, labels[at], weights[at])
            for k, table in enumerate(model.embed):
                rows, grad = grads[f"e{k}"]
                opt[f"e{k}"].step(table, grad, rows)
                table[PAD] = 0
            for name, value in own.items():
                opt[name].step(value, grads[name])
            model.out_bias = float(own["ob"][0])
    return model


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The score with the best F1 as a lower limit; of equal ones the middle of the gap below it."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(labels[order])
    f1 = 2 * hits / (np.arange(len(order)) + 1 + max(labels.sum(), 1))
    k = int(f1.argmax())
    low = scores[order[k + 1]] if k + 1 < len(order) else 0.0
    return float((scores[order[k]] + low) / 2)


def fit(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_chars: int = MAX_CHARS, min_calibration: int = 20) -> Model:
    """A model from the labelled rows that are not held out.

    At most max_positive ids with toxic = 1 and max_negative with toxic = 0 are used: those with the smallest hashes of
    their id, the same ones on every run, with one row each (of repeated rows that with the smallest text hash) and
    max_chars characters in all. Only their word numbers reach the driver. A fifth of them isn't trained on and
    picks one of RESTARTS models and calibrates a threshold for each language with at least min_calibration of each label. The loss is weighted back to
    the share of positives among all labelled rows that aren't held out, so that scores are probabilities.

    Null ids and null labels are left out, null texts are empty ones; an id with both labels counts as toxic. Without
    labelled rows the model scores every text 0.5. Label columns other than toxic aren't read; language picks a
    threshold, no score.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col("toxic").alias("y")).filter("label_id is not null and y in (0, 1)")
    pool = known.filter(~held_out("label_id")).groupBy("label_id").agg(F.max("y").alias("y"))
    share = {r["y"]: r["n"] for r in pool.groupBy("y").agg(F.count("*").alias("n")).collect()}
    mixed = F.xxhash64("label_id")
    chosen = pool.filter("y = 1").orderBy(mixed, "label_id").limit(max_positive).unionByName(pool.filter("y = 0").orderBy(mixed, "label_id").limit(max_negative))
    lang = F.col(f"`{lang_col}`") if lang_col else F.lit(None).cast("string")
    text = text_of(F.col(f"`{text_col}`"))
    docs = df.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), lang.alias("lang"))
    chosen = checkpointed(chosen)  # a few thousand rows, by the limits above
    one = docs.join(F.broadcast(chosen), F.col("id") == F.col("label_id")).groupBy("id", "y").agg(F.min_by(F.struct("text", "lang"), F.xxhash64("text", "lang")).alias("r"))
    joined = checkpointed(one.select("id", F.col("r.text").alias("text"), F.col("r.lang").alias("lang"), "y"))
    sizes = sorted(joined.select(F.xxhash64("id").alias("h"), "id", F.length("text").alias("n")).collect())
    room, fits = max_chars, []
    for _, i, n in sizes:
        if n <= room:
            room -= n
            fits.append(i)
    if len(fits) < len(sizes):
        joined = joined.filter(F.col("id").isin(fits))

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for r in batch.to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([r["id"]], pa.int64()), pa.array([word_ids(r["text"]).astype("<i4").tobytes()]), pa.array([r["lang"]], pa.string()), pa.array([r["y"]], pa.int32())], ["id", "ids", "lang", "y"])

    rows = sorted(joined.mapInArrow(encode, "id long, ids binary, lang string, y int").collect(), key=lambda r: (r["id"], r["ids"]))
    ids = [np.frombuffer(r["ids"], "<i4").reshape(-1, 2) for r in rows]
    y = np.array([r["y"] for r in rows], np.float32)
    apart = np.array([crc32(f"calibrate{r['id']}".encode()) % 5 == 0 for r in rows], bool)
    total = max(sum(share.values()), 1)
    weight = np.array([share.get(k, 0) / total / max((y == k).sum(), 1) for k in (0, 1)])
    own = weight[y.astype(int)] * max(len(y), 1) if len(y) else np.zeros(0)
    picked = np.flatnonzero(~apart)
    at = np.flatnonzero(apart)

    def attempt(seed: int) -> tuple[float, int, Model, np.ndarray]:
        """(weighted logistic loss of the calibration rows, seed, the model, their scores)."""
        model = train([ids[k] for k in picked], y[picked], own[picked].astype(np.float32), seed=seed)
        scores = np.array([model.score_ids(ids[k]) for k in at])
        right = np.where(y[at] == 1, scores, 1 - scores)
        return float(-(own[at] * np.log(np.maximum(right, 1e-12))).sum()), seed, model, scores

    _, _, model, scores = min(attempt(7 + k) for k in range(RESTARTS if len(at) else 1))
    if not len(rows):
        model.out[:] = 0
    if len(at):
        langs = np.array([rows[k]["lang"] or "" for k in at])
        for name in sorted(set(langs)):
            same = langs == name
            if min(y[at][same].sum(), (1 - y[at][same]).sum()) >= min_calibration:
                model.thresholds[name] = best_threshold(scores[same], y[at][same])
    return model


def score(df: DataFrame, model: Model, text_col: str = "text", lang_col: str | None = "lang") -> tuple[DataFrame, str, str]:
    """df with a score of each whole text and toxic (score at or over the language's threshold), and both names.

    Null text is empty and gets the score of a text without words. Rows are scored by themselves, so repeated rows get
    one score, an empty table stays empty, and nothing is shuffled. Whole texts are read. Columns of any name are allowed.
    The model (about 4 MB, whatever the corpus) is broadcast.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scores(texts):
        import pandas as pd

        m = shared.value
        return pd.Series([m.score(t) for t in texts], dtype="float64")

    name = fresh("score", df.columns)
    flag = fresh("toxic", [*df.columns, name])
    limit = F.lit(model.default_threshold)
    for lang, value in model.thresholds.items():
        limit = F.when(F.col(f"`{lang_col}`") == lang, value).otherwise(limit) if lang_col else limit
    return df.withColumn(name, scores(F.col(f"`{text_col}`"))).withColumn(flag, F.col(name) >= limit), name, flag
