"""Operator 6: language identification by sparse multinomial logistic regression.

Features are character n-grams (one to three characters, case folded, words set apart by one blank), hashed into
``BUCKETS`` and weighted by term frequency and inverse document frequency. Document frequencies are counted over all
training documents. The regression is trained by follow-the-regularised-leader with an elastic-net penalty, which leaves
most weights zero, on a bounded sample of every language, and its confidence
is calibrated by a temperature fitted to part of that sample that was kept from training.

The sample: ``sample_docs`` documents dealt evenly over the languages, but ``least_docs`` of a language that has as many, with
``sample_chars`` characters of each language at most; the first by a hash of key and text. All languages of the training documents are learned. The
model is trained in one task of an executor, which reads the sample's n-gram counts.

Edge cases: a null text or one without a letter gets ``und`` with score 0; without training rows so does every text; null
languages are not learned; repeated rows get a row each and are drawn once;
texts of any length count whole; columns other than key and text (and, for training, the language) are not read, whatever their names; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, crc_fold, in_one_task, sampled, table, text_of

BUCKETS = 1 << 16
UNDETERMINED = "und"


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of the n-grams of a text, and the count of each."""
    low = " ".join(["", *text.lower().split(), ""])
    c = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    with np.errstate(over="ignore"):
        c1 = c * np.uint32(0x9E3779B1)
        c2 = (c1[:-1] ^ (c1[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + c1[1:]
        c3 = (c2[:-1] ^ (c2[:-1] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + c1[2:]
    grams = np.concatenate([(x ^ (x >> np.uint32(16))) & np.uint32(BUCKETS - 1) for x in (c1 ^ np.uint32(0x27D4EB2F), c2, c3)])
    counts = np.bincount(grams, minlength=BUCKETS)
    hit = np.flatnonzero(counts)
    return hit, counts[hit]


def has_letter(text: str) -> bool:
    return text.isalpha() or any(map(str.isalpha, text))


def weighted(hit: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(counts)) * idf[hit]
    return v / max(float(np.sqrt((v * v).sum())), 1e-9)


class LanguageModel:
    def __init__(self, languages: list[str], weights: np.ndarray, idf: np.ndarray, temperature: float = 1.0) -> None:
        self.languages, self.idf, self.temperature = languages, idf, temperature
        #: ``[buckets + 1, languages]``; the last row is the constant.
        self.weights = weights

    def logits(self, hit: np.ndarray, value: np.ndarray) -> np.ndarray:
        return value @ self.weights[hit] + self.weights[-1]

    def predict(self, text: str) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNDETERMINED, 0.0
        hit, counts = ngrams(text)
        z = self.logits(hit, weighted(hit, counts, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.languages[k], float(p[k] / p.sum())


def fit(rows: list[tuple[np.ndarray, np.ndarray, str]], idf: np.ndarray, languages: list[str], alpha: float = 1.0, beta: float = 1.0, l1: float = 0.3, l2: float = 0.5, sweeps: int = 3, seed: int = 11) -> LanguageModel:
    """``rows``: buckets, counts and language. Follow-the-regularised-leader, proximal form, one state per weight."""
    if not rows:
        return LanguageModel([], np.zeros((BUCKETS + 1, 0), np.float32), idf)
    number = {v: k for k, v in enumerate(languages)}
    data = [(np.append(hit, BUCKETS), np.append(weighted(hit, n, idf), 1.0), number[v]) for hit, n, v in rows if v in number]
    held, train = data[::5], [d for k, d in enumerate(data) if k % 5 or len(data) < 10]
    z = np.zeros((BUCKETS + 1, len(languages)))
    n = np.zeros_like(z)
    draw = np.random.default_rng(seed)

    def weights(at: np.ndarray) -> np.ndarray:
        zz, nn = z[at], n[at]
        return np.where(np.abs(zz) <= l1, 0.0, (np.sign(zz) * l1 - zz) / ((beta + np.sqrt(nn)) / alpha + l2))

    for _ in range(sweeps):
        for i in draw.permutation(len(train)):
            hit, value, y = train[i]
            w = weights(hit)
            s = value @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1.0
            g = value[:, None] * p[None]
            old = n[hit]
            n[hit] = old + g * g
            z[hit] += g - (np.sqrt(n[hit]) - np.sqrt(old)) / alpha * w
    model = LanguageModel(languages, weights(np.arange(BUCKETS + 1)).astype(np.float32), idf)
    s, y = np.array([value @ model.weights[hit] for hit, value, _ in held]), np.array([k for *_, k in held])

    def loss(t: float) -> float:
        a = s / t
        a = a - a.max(1, keepdims=True)
        return float((np.log(np.exp(a).sum(1)) - a[np.arange(len(y)), y]).mean())

    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """In how many documents each bucket occurs, and the number of documents: one row a task and bucket is summed."""

    def count(batches):
        df, n = np.zeros(BUCKETS, np.int64), 0
        for b in batches:
            for t in b.column(0).to_pylist():
                df[ngrams(t)[0]] += 1
                n += 1
        hit = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*hit.tolist(), -1], pa.int32()), pa.array([*df[hit].tolist(), n], pa.int64())], ["bucket", "n"])

    summed: pd.DataFrame = docs.select(text_of(text).alias("t")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS, np.int64)
    known = summed["bucket"] >= 0
    df[summed["bucket"][known]] = summed["n"][known]
    return df, int(summed["n"][~known].sum())


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", language: str = "lang", sample_docs: int = 4000, least_docs: int = 20, sample_chars: int = 20_000_000) -> LanguageModel:
    known = docs.where(F.col(language).isNotNull()).select(F.col(key).alias("key"), text_of(text).alias("text"), F.col(language).cast("string").alias("lang"))
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    n_languages = known.select("lang").distinct().count()
    rows = sampled(known, "key", "text", "language", max(least_docs, sample_docs // max(n_languages, 1)), sample_chars, F.col("lang"))

    def counted():
        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            found = [ngrams(t) for t in b.column(2).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x[0].astype(np.int32) for x in found], pa.list_(pa.int32())), pa.array([x[1].astype(np.int32) for x in found], pa.list_(pa.int32()))], ["h", "lang", "hit", "n"])

        return each

    def make(sample: pa.Table) -> pa.RecordBatch:
        languages = sorted(set(sample["lang"].to_pylist()))
        part = lambda name: [x.values.to_numpy() for x in sample[name]]
        model = fit(list(zip(part("hit"), part("n"), sample["lang"].to_pylist(), strict=True)), idf, languages)
        at = np.flatnonzero(model.weights)
        parts = [pa.array([languages], pa.list_(pa.string())), pa.array([at.astype("<i8").tobytes()], pa.binary()), pa.array([model.weights.ravel()[at].tobytes()], pa.binary()), pa.array([model.temperature], pa.float64())]
        return pa.RecordBatch.from_arrays(parts, ["languages", "place", "weight", "temperature"])

    counts = arrow_map(rows.select("h", "g", "t"), counted, "h long, lang string, hit array<int>, n array<int>")
    found = in_one_task(counts, "h", make, "languages array<string>, place binary, weight binary, temperature double").first()
    if found is None:
        return fit([], idf, [])
    weights = np.zeros((BUCKETS + 1, len(found["languages"])), np.float32)
    weights.ravel()[np.frombuffer(found["place"], "<i8")] = np.frombuffer(found["weight"], np.float32)
    return LanguageModel(list(found["languages"]), weights, idf, found["temperature"])


def predict_language(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score`` of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = sent.value

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            lang, score = zip(*map(own.predict, b.column(1).to_pylist()), strict=True)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["key", "lang_pred", "score"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(docs.select(F.col(key).alias("key"), text_of(text).alias("text")), make, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_fold("doc_id", 4) == 2
    model = train(docs.where(~held_out))
    return predict_language(docs.drop("lang"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
