"""Quality classifier by compression.

Two Zstandard dictionaries are trained, one on texts labelled good, one on texts labelled bad. A text is cut into blocks,
each block is compressed against both, and the difference of the summed sizes over the number of bytes is the evidence:
a text costs less against the dictionary that it resembles. A logistic curve, fitted on labelled texts that were kept
from the dictionaries, turns the evidence into a calibrated score.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import append_texts, held_fold, map_texts, table

#: Labelled rows drawn per class at most, and the longest text (bytes) that is drawn. Scoring has no such bounds.
SAMPLE_ROWS, SAMPLE_BYTES = 3000, 65_536
#: Bytes of a dictionary, bytes of a block, level.
DICT_BYTES, BLOCK, LEVEL = 65_536, 4096, 3


@dataclass
class Model:
    good: bytes = b""
    bad: bytes = b""
    bias: float = 0.0
    slope: float = 0.0

    def scorer(self):
        if not (self.good and self.bad):
            p = 1 / (1 + math.exp(-self.bias))
            return lambda texts: np.full(len(texts), p)
        pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (self.good, self.bad)]
        return lambda texts: 1 / (1 + np.exp(-np.clip(self.bias + self.slope * evidence(texts, *pair), -30, 30)))


def dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    d = zstandard.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def evidence(texts: list, good, bad) -> np.ndarray:
    """Bytes saved by the good dictionary against the bad one, by input byte; 0 for an empty text."""
    out = np.zeros(len(texts))
    for i, t in enumerate(texts):
        diff = 0
        for at in range(0, len(t), BLOCK):
            block = t[at : at + BLOCK]
            diff += len(bad.compress(block)) - len(good.compress(block))
        out[i] = diff / max(1, len(t))
    return out


def fit(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from labelled rows for which the condition ``train`` (on the id) holds.

    At most ``sample_rows`` ids of each class are drawn, those with the smallest hash of the id, so the draw is the same
    however the rows lie. Ids whose labels disagree are not drawn, nor are null ids, null labels and texts of more than
    ``sample_bytes``. With no rows of a class the score is the share of good labels for every text (0.5 without labels).
    """
    known = (
        labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y"))
        .withColumnRenamed("__id", id_col).filter(train).filter(F.col(id_col).isNotNull() & F.col("__y").isin(0, 1))
        .groupBy(id_col).agg(F.min("__y").alias("__y"), F.max("__y").alias("__z")).filter("__y = __z").drop("__z")
    )
    counts = {r["__y"]: r["n"] for r in known.groupBy("__y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = counts.get(0, 0), counts.get(1, 0)
    if not n0 or not n1:
        return Model(bias=math.log((n1 + 0.5) / (n0 + 0.5)))
    rank = F.xxhash64(F.col(id_col).cast("string"))
    drawn = known.filter("__y = 0").orderBy(rank, id_col).limit(sample_rows).unionByName(known.filter("__y = 1").orderBy(rank, id_col).limit(sample_rows))
    rows = (
        docs.select(id_col, F.col(text_col).cast("binary").alias("__t")).filter(F.octet_length("__t").between(1, sample_bytes))
        .join(F.broadcast(drawn), id_col)  # at most 2 * sample_rows ids
        .orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(2 * sample_rows)
        .select("__y", "__t").collect()
    )
    by = {y: [bytes(r["__t"]) for r in rows if r["__y"] == y] for y in (0, 1)}
    built = {y: train_dictionary(by[y][::2]) for y in (0, 1)}
    if not all(built.values()) or min(len(by[0]), len(by[1])) < 2:
        return Model(bias=math.log((n1 + 0.5) / (n0 + 0.5)))
    model = Model(built[1], built[0])
    pair = [zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary(d), write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    x = np.concatenate([evidence(by[0][1::2], *pair), evidence(by[1][1::2], *pair)])
    y = np.repeat([0.0, 1.0], [len(by[0][1::2]), len(by[1][1::2])])
    weight = np.where(y == 1, n1 / max(1, y.sum()), n0 / max(1, (1 - y).sum()))
    model.bias, model.slope = logistic(x, y, weight / weight.mean())
    return model


def train_dictionary(samples: list) -> bytes:
    """A dictionary of at most DICT_BYTES; the samples' own bytes where they are too few to train on."""
    blocks = [t[at : at + BLOCK] for t in samples for at in range(0, len(t), BLOCK)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, blocks, k=64, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(blocks)[:DICT_BYTES]


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Bias and slope by Newton's method, with a small ridge so that separable data give finite values."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([np.ones_like(x), x / scale], 1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        g = a.T @ (w * (p - y)) + ridge * len(x) * np.array([0, beta[1]])
        h = (a * (w * p * (1 - p))[:, None]).T @ a + ridge * len(x) * np.diag([1e-6, 1.0])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        beta = beta - step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def score(docs: DataFrame, model: Model, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: tuple = ()) -> DataFrame:
    """One row per row of ``docs``: id, score (0 to 1) and predicted (1 from ``threshold``). Null texts count as empty;
    repeated rows get repeated results, an empty table none. Only the text enters the score; other columns are not read."""
    return map_texts(docs, Scorer(model, threshold), "score double, predicted int", id_col, text_col, keep)


class Scorer:
    """Builds the compressors once in each Python worker; only the dictionaries' bytes are sent."""

    def __init__(self, model: Model, threshold: float):
        self.model, self.threshold, self.made = model, threshold, None

    def __getstate__(self):
        return {"model": self.model, "threshold": self.threshold, "made": None}

    def __call__(self, texts: list) -> dict:
        self.made = self.made or self.model.scorer()
        s = self.made(texts)
        return {"score": s, "predicted": (s >= self.threshold).astype(np.int32)}


def accepted(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; all its columns, unchanged, whatever their names."""
    scored, name = append_texts(docs, Scorer(model, threshold), {"score": "double", "predicted": "int"}, text_col)
    return scored.filter(F.col(name["predicted"]) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), ~held_fold("doc_id", 4, 2))
    return score(docs, model).select("doc_id", held_fold("doc_id", 4, 2).alias("held_out"), "score", "predicted")
