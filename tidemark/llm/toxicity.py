"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on the text of toxic documents and
one on ordinary text, each document's windows being a sample. A window (a
lower-cased word with its neighbours' spaces) is compressed under both, and the
difference of the two lengths tells which text it comes from. Windows are a few
bytes, so each byte is written ``REPEAT`` times: shared strings of four letters
then pay for the match that replaces them. The ordinary dictionary is the
larger: what a toxic document shares with ordinary text is found in it too.

Labels mark documents, not words. The toxic dictionary is therefore trained a
second time, on those windows of the toxic documents whose distance under the
first pair is one that ordinary windows rarely reach (``RARE``). A document's
largest distances, and how many windows pass such a level, go into a logistic
calibration. It is fitted on a bounded sample of the labelled rows, and scores
each third under the other thirds' dictionaries. Windows, dictionaries and
distances of the sample are made in tasks; the driver gets the dictionaries and
a few numbers a sampled row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialize, small_batches, unused

#: Labelled rows of each class that the classifier is fitted on, at most, by hash order.
FIT_TOXIC, FIT_ORDINARY = 1200, 2800
FOLDS = 3
REPEAT, LEVEL = 3, 19
#: Dictionary sizes (of the toxic one: at first, and trained again), and the lengths of its selected segments.
TOXIC_BYTES, ORDINARY_BYTES, SEGMENT = (65_536, 32_768), 262_144, 60
#: Share of ordinary windows beyond the level that selects windows, and beyond the one that counts them.
RARE, COUNTED = 1e-3, 5e-4
THRESHOLD = 0.7
EDGE = b".,;:!?\"'()[]*#$%&|<>=+-_/"
CACHE = 400_000
#: A word of more bytes is scored in pieces of this length.
WINDOW_BYTES = 64


def windows(text: str | None) -> list[bytes]:
    """The distinct windows of a text: words without outer signs, long ones in pieces."""
    found = {w.strip(EDGE) for w in (text or "").lower().encode("utf-8", "replace").split()}
    found.discard(b"")
    long = [w for w in found if len(w) > WINDOW_BYTES]
    for w in long:
        found.discard(w)
        found.update(w[i : i + WINDOW_BYTES] for i in range(0, len(w), WINDOW_BYTES))
    return sorted(found)


def stretched(window: bytes) -> bytes:
    return bytes(np.repeat(np.frombuffer(b" " + window + b" ", dtype=np.uint8), REPEAT))


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary from ``samples``; too few to train on serve as they are."""
    import zstandard

    total = sum(map(len, samples))
    while size > 1024 and total < 4 * size:
        size //= 2
    try:
        return zstandard.train_dictionary(size, samples, k=SEGMENT, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:] or b" " * 8


def dictionaries(toxic: list[list[bytes]], ordinary: list[list[bytes]]) -> tuple[bytes, bytes, float]:
    """The toxic and the ordinary dictionary from documents' windows, and the level that few ordinary windows reach."""

    def samples(docs):
        return [b"".join(map(stretched, own)) for own in docs if own]

    plain = train_dictionary(samples(ordinary), ORDINARY_BYTES)
    first = Distance(train_dictionary(samples(toxic), TOXIC_BYTES[0]), plain)
    usual = np.concatenate([first.of(own) for own in ordinary] or [np.zeros(1)])
    level = max(1.0, float(np.quantile(usual, 1 - RARE)))
    telling = [w for own in toxic for w, d in zip(own, first.of(own), strict=True) if d >= level]
    grouped = [b"".join(map(stretched, telling[i : i + 8])) for i in range(0, len(telling), 8)]
    again = train_dictionary(grouped, TOXIC_BYTES[1])
    second = Distance(again, plain)
    usual = np.concatenate([second.of(own) for own in ordinary] or [np.zeros(1)])
    return again, plain, float(np.quantile(usual, 1 - COUNTED))


class Distance:
    """Window lengths under the ordinary less those under the toxic dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard

        self.both = []
        for data in (ordinary, toxic):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            made = zstandard.ZstdCompressor(
                level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False
            )
            self.both.append(made.compress)
        self.cache: dict[bytes, int] = {}

    def of(self, found: list[bytes]) -> np.ndarray:
        cache, (ordinary, toxic) = self.cache, self.both
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for w in found:
            d = cache.get(w)
            if d is None:
                x = stretched(w)
                d = cache[w] = len(ordinary(x)) - len(toxic(x))
            out.append(d)
        return np.array(out, dtype=np.float64)


def features(distances: np.ndarray, level: float) -> list[float]:
    """Largest three distances, windows at or above ``level``, and the number of windows."""
    top = np.sort(distances)[::-1][:3]
    top = np.concatenate([top, np.full(3 - len(top), -20.0)]) if len(top) < 3 else top
    return [*np.maximum(top, -20.0), math.log1p(float((distances >= level).sum())), math.log1p(len(distances))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ridge logistic regression by Newton steps: (centre, scale, weights with the bias first)."""
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    w = np.zeros(a.shape[1])
    keep = np.diag([0.0] + [ridge * len(x)] * (a.shape[1] - 1)) / 100 + 1e-9 * np.eye(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + keep + 1e-6 * np.eye(len(w)), a.T @ (y - p) - keep @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w


def score(text: str | None, model: dict, measure: Distance | None) -> float:
    if measure is None:
        return model["constant"]
    centre, scale, w = (np.array(v) for v in model["weights"])
    z = w[0] + float(((np.array(features(measure.of(windows(text)), model["level"])) - centre) / scale) @ w[1:])
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of labelled documents outside the held-out third."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = known.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.join(known, "doc_id")


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, fold, label, windows) of at most FIT_TOXIC and FIT_ORDINARY labelled documents.

    They are the first by a hash of the doc_id, settled on ids alone; of rows
    that share an id the one whose text has the least hash is taken. The
    windows are those of the whole texts.
    """
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
    ids = ids.where("doc_id IS NOT NULL AND label IN (0, 1)").groupBy("doc_id").agg(F.max("label").alias("label"))
    ids = ids.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).withColumn("h", F.xxhash64(F.lit(10), "doc_id"))
    known = ids.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi")
    chosen = [known.where(F.col("label") == c).orderBy("h", "doc_id").limit(n) for c, n in ((1, FIT_TOXIC), (0, FIT_ORDINARY))]
    chosen = [r["doc_id"] for part in chosen for r in part.select("doc_id").collect()]
    rows = training_rows(docs, labels, "toxic").where(F.col("doc_id").isin(chosen))
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))

    @F.pandas_udf("array<binary>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(windows)

    fold = F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(FOLDS)).cast("int").alias("fold")
    return materialize(rows.select("doc_id", fold, "label", cut("text").alias("windows")), "toxicity-sample")


def _train_part(pdf: pd.DataFrame) -> pd.DataFrame:
    """The dictionaries of one part of the sample: all but one fold, or all."""
    pdf = pdf.sort_values("doc_id")
    by = [[[bytes(w) for w in own] for own in pdf.loc[pdf["label"] == c, "windows"]] for c in (1, 0)]
    toxic, ordinary, level = dictionaries(*by)
    return pd.DataFrame({"part": [pdf["part"].iat[0]], "toxic": [toxic], "ordinary": [ordinary], "level": [level]})


def train(docs: DataFrame, labels: DataFrame) -> dict:
    """Fit the classifier on the sample: dictionaries in a task each, the calibration on a few numbers a row."""
    spark = docs.sparkSession
    rows = sample(docs, labels)
    counts = {(r["fold"], r["label"]): r["n"] for r in rows.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = [sum(v for (_, c), v in counts.items() if c == label) for label in (0, 1)]
    if not all(n):
        return {"constant": float(n[1] > 0)}
    # Part f lacks fold f; part FOLDS has all. Both classes must be left in a part.
    parts = [f for f in range(FOLDS) if all(n[c] > counts.get((f, c), 0) for c in (0, 1))]
    share = {"constant": n[1] / sum(n)}
    if not parts:
        return share
    each = F.array(*[F.lit(p) for p in (*parts, FOLDS)])
    dealt = rows.withColumn("part", F.explode(F.filter(each, lambda p: p != F.col("fold"))))
    found = dealt.groupBy("part").applyInPandas(_train_part, "part int, toxic binary, ordinary binary, level double").collect()
    made = {r["part"]: (bytes(r["toxic"]), bytes(r["ordinary"]), r["level"]) for r in found}
    sent = spark.sparkContext.broadcast(made)

    def described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        measures = {p: Distance(*m[:2]) for p, m in sent.value.items() if p != FOLDS}
        for pdf in batches:
            use = pdf[[f in measures for f in pdf["fold"]]]
            x = [features(measures[f].of([bytes(w) for w in own]), sent.value[f][2]) for f, own in zip(use["fold"], use["windows"], strict=True)]
            yield pd.DataFrame({"doc_id": use["doc_id"], "label": use["label"], "x": x})

    own = rows.mapInPandas(described, "doc_id long, label int, x array<double>").collect()  # a few numbers a sampled row
    own.sort(key=lambda r: r["doc_id"])
    y = np.array([r["label"] for r in own], dtype=float)
    if not 0 < y.sum() < len(y):
        return share
    # Probabilities are those of the sample, in which toxic documents are over-represented.
    weights = [v.tolist() for v in logistic(np.array([r["x"] for r in own]), y)]
    level = float(np.mean([made[p][2] for p in parts]))
    toxic, ordinary, _ = made[FOLDS]
    return {"toxic": toxic, "ordinary": ordinary, "level": level, "weights": weights}


_MEASURES: dict[int, Distance] = {}


def _measure(model: dict) -> Distance | None:
    if "constant" in model:
        return None
    key = hash((model["toxic"], model["ordinary"]))
    if key not in _MEASURES:
        _MEASURES.clear()
        _MEASURES[key] = Distance(model["toxic"], model["ordinary"])
    return _MEASURES[key]


def with_score(docs: DataFrame, labels: DataFrame, out: str = "_score") -> DataFrame:
    """``docs`` (doc_id, text, others untouched) with ``out``, the calibrated probability of being toxic.

    Null and empty texts are scored like texts without windows; very long texts
    are scored whole. Without labelled rows of both classes all scores are the
    one class seen, else 0. Each row is scored by itself: repeated rows get
    equal scores. ``docs`` must not have a column of the name ``out``. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(train(docs, labels))

    @F.pandas_udf("double")
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = sent.value
        measure = _measure(model)
        for part in texts:
            yield pd.Series([score(t, model, measure) for t in part], dtype="float64")

    return docs.withColumn(out, scored(F.col("text").cast("string")))


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = with_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    return scored.select(
        "doc_id",
        F.coalesce(held, F.lit(False)).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def toxicity_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose score reaches the threshold.

    Null, empty and very long texts, repeated rows and null doc_ids are scored
    row by row as :func:`with_score` says; columns of any name pass through; an
    empty table stays empty.
    """
    name = unused(docs, "_score")
    scored = with_score(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), name)
    return scored.where(F.col(name) < THRESHOLD).drop(name)
