"""Quality scores by regularised quadratic discriminant analysis.

Each document becomes a vector of transformed statistics (logs of counts,
square roots of shares). Class means and covariances come from sums over all
labelled training rows, added up in parallel. Every covariance is shrunk
towards the pooled one and its diagonal; its Cholesky factor is kept, and a
score is the logistic of the difference of the two Mahalanobis log-densities.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialize, small_batches

FEATURES = (
    "length", "words", "word_length", "word_spread", "distinct", "top_word", "pair_repeat", "upper", "digits",
    "signs", "odd_signs", "letters_only", "line_length", "line_repeat", "ends", "deflate", "capitals", "stops",
)
#: Shares of the pooled covariance and of its diagonal in a class's covariance.
POOLED, DIAGONAL = 0.1, 0.05
SIGNS = np.zeros(256, dtype=bool)
SIGNS[[b for b in range(33, 127) if not chr(b).isalnum()]] = True
PLAIN_SIGNS = [ord(c) for c in ".,'-\"?;:"]
SAMPLE_BYTES = 1 << 16


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a whole text (null: as empty)."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, size = len(words), len(raw)
    if not n:
        return [math.log1p(size), *[0.0] * (len(FEATURES) - 1)]
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    each = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    inked = max(1, size - int(counts[[9, 10, 11, 12, 13, 32]].sum()))
    signs = int(counts[SIGNS].sum())
    letters = int(counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum())
    packed = sum(len(zlib.compress(raw[i : i + SAMPLE_BYTES], 1)) for i in range(0, size, SAMPLE_BYTES))
    pure = sum(map(bytes.isalpha, words))
    root = math.sqrt
    return [
        math.log1p(size),
        math.log1p(n),
        math.log(float(lengths.mean())),
        math.log1p(float(lengths.std())),
        root(len(each) / n),
        root(each.most_common(1)[0][1] / n),
        root(1 - pairs / max(1, n - 1)) if n > 1 else 0.0,
        root(int(counts[65:91].sum()) / max(1, letters)),
        root(int(counts[48:58].sum()) / inked),
        root(signs / inked),
        root((signs - int(counts[PLAIN_SIGNS].sum())) / inked),
        root(pure / n),
        math.log1p(n / len(lines)),
        root(1 - len(set(lines)) / len(lines)),
        root(int(counts[46] + counts[33] + counts[63]) / n),
        packed / size,
        root(sum(map(bytes.istitle, words)) / n),
        root(sum(c for w, c in each.items() if len(w) <= 3) / n),
    ]


def _statistics(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "x": [statistics(t) for t in pdf["text"]]})


def _moments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per class, of this partition: count, sum and sum of outer products."""
    d = len(FEATURES)
    sums = {c: np.zeros(1 + d + d * d) for c in (0, 1)}
    for pdf in batches:
        for c in (0, 1):
            own = pdf.loc[pdf["label"] == c, "x"]
            if len(own):
                x = np.stack(own.to_list())
                sums[c] += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
    for c, s in sums.items():
        if s[0]:
            yield pd.DataFrame({"label": np.int32(c), "i": np.arange(len(s), dtype=np.int32), "v": s})


def fit(moments: dict[int, np.ndarray], pooled: float = POOLED, diagonal: float = DIAGONAL) -> dict:
    """Means, inverse Cholesky factors and offsets of both classes from their moments."""
    d = len(FEATURES)
    if set(moments) != {0, 1}:
        return {"constant": float(1 in moments)}
    parts, scatter, total = {}, np.zeros((d, d)), 0.0
    for c, s in moments.items():
        n, mean = s[0], s[1 : 1 + d] / s[0]
        own = s[1 + d :].reshape(d, d) - n * np.outer(mean, mean)
        parts[c] = (n, mean, own)
        scatter, total = scatter + own, total + n
    scatter = scatter / max(1.0, total - 2)
    floor = 1e-4 * np.eye(d)
    model: dict = {}
    for c, (n, mean, own) in parts.items():
        # Few rows lean more on what both classes share.
        share = min(1.0, pooled + d / (n + d))
        cov = (1 - share) * own / max(1.0, n - 1) + share * scatter
        cov = (1 - diagonal) * cov + diagonal * np.diag(np.diag(cov)) + floor
        lower = np.linalg.cholesky(cov)
        model[c] = (mean, np.linalg.inv(lower), math.log(n / total) - np.log(np.diag(lower)).sum())
    return model


def scores(x: np.ndarray, model: dict) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    logs = []
    for c in (0, 1):
        mean, inverse, offset = model[c]
        z = (x - mean) @ inverse.T
        logs.append(offset - 0.5 * np.einsum("ij,ij->i", z, z))
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -40, 40)))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out and score of every row of ``docs`` (doc_id, text).

    Trained on the labelled rows with crc32(doc_id) mod 3 other than 1. Null
    and empty texts have zero statistics and are scored like others. Without
    labels of both classes the score is the class seen, else 0. Repeated rows
    are scored alike; a null doc_id is scored and not held out. Very long texts
    count whole. Ties have no part in it. Other columns, whatever their names,
    are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    table = materialize(slim.mapInPandas(_statistics, "doc_id long, x array<double>"), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    train = table.join(known.where(~held), "doc_id").select("label", "x")
    sums = train.mapInPandas(_moments, "label int, i int, v double").groupBy("label", "i").agg(F.sum("v").alias("v"))
    moments: dict[int, np.ndarray] = {}
    for r in sums.collect():  # two classes of 1 + d + d x d sums
        moments.setdefault(r["label"], np.zeros(1 + len(FEATURES) * (1 + len(FEATURES))))[r["i"]] = r["v"]
    model = spark.sparkContext.broadcast(fit(moments))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                values = scores(np.stack(pdf["x"].to_list()), model.value)
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": values})

    out = table.mapInPandas(scored, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
