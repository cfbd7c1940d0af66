"""Language identification by interpolated Kneser-Ney character models.

Every language's character trigrams are counted over all its training texts.
The model of a language is a few sorted arrays of n-gram codes with counts and
context sums; probabilities back off from trigrams to bigram and unigram
continuation counts with absolute discounts. A text gets the language of the
lowest cross-entropy per character. Rejection is calibrated on all training
texts: a text whose cross-entropy is far above what its language's own texts
have is marked as rejected.

The models' arrays are broadcast up to ``MODEL_ROWS`` n-grams in all (counted
first). Beyond that the same probabilities are joined: the costs of the
distinct trigrams of the texts come from joins with the n-gram tables, and the
texts' own trigrams are joined with these.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import materialize, small_batches

BITS = 20
ONE, TWO = (1 << BITS) - 1, (1 << 2 * BITS) - 1
SPACE = 32
#: Standard deviations above the mean cross-entropy at which a text is rejected.
REJECT = 4.0
#: Sharpness of the score: nats per character times this.
SHARPNESS = 10.0
UNDETERMINED = "und"
#: N-grams of all languages together up to which the models are broadcast (some 60 bytes each).
MODEL_ROWS = 4_000_000

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """1 for letters, 2 for marks, of the first 2^16 code points."""
    global _LETTER
    if _LETTER is None:
        kinds = [unicodedata.category(chr(c)) for c in range(1 << 16)]
        _LETTER = np.array([1 if k[0] == "L" else 2 if k[0] == "M" else 0 for k in kinds], dtype=np.uint8)
    return _LETTER


def codes(text: str | None) -> np.ndarray | None:
    """Character codes of a text: lower-cased letters and marks, runs of all
    else as one space, a space at both ends. None without a letter."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), dtype="<u4")
    kind = _letters()[np.minimum(raw, 0xFFFF)]
    if len(raw) and raw.max() > 0xFFFF:
        above = np.flatnonzero(raw > 0xFFFF)
        kind[above] = [unicodedata.category(chr(c))[0] == "L" for c in raw[above]]
    if not (kind == 1).any():
        return None
    out = np.concatenate([[SPACE], np.where(kind > 0, raw, SPACE), [SPACE]]).astype(np.int64) & ONE
    blank = out == SPACE
    return out[~(blank & np.concatenate([[False], blank[:-1]]))]


def trigrams(c: np.ndarray) -> np.ndarray:
    """Codes of all trigrams; the first character's context is the space before it."""
    c = np.concatenate([[SPACE], c])
    return c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:]


def _summed(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(grams), return_inverse=True)
    return found, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, list] = {}
    for pdf in batches:
        for lang, own in pdf.groupby("lang")["text"]:
            found = [trigrams(c) for c in map(codes, own) if c is not None]
            if found:
                g, n = np.unique(np.concatenate(found), return_counts=True)
                grams, counts = held.setdefault(lang, ([], []))
                grams.append(g)
                counts.append(n)
                if sum(map(len, grams)) > 2_000_000:
                    g, n = _summed(grams, counts)
                    held[lang] = ([g], [n])
    for lang, (grams, counts) in held.items():
        g, n = _summed(grams, counts)
        yield pd.DataFrame({"lang": lang, "gram": g, "n": n})


def discount(counts: np.ndarray) -> float:
    one, two = int((counts == 1).sum()), int((counts == 2).sum())
    return min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5


def _grouped(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sum and the number of their counts."""
    found, at, distinct = np.unique(keys, return_inverse=True, return_counts=True)
    return found, np.bincount(at, weights=counts), distinct.astype(float)


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


class Model:
    """Interpolated Kneser-Ney model of one language in sorted arrays."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, alphabet: int):
        order = np.argsort(grams)
        self.tri, self.tri_n = grams[order], counts[order].astype(float)
        self.bi, self.bi_n = np.unique(self.tri & TWO, return_counts=True)
        self.uni, self.uni_n = np.unique(self.bi & ONE, return_counts=True)
        self.bi_n, self.uni_n = self.bi_n.astype(float), self.uni_n.astype(float)
        self.d3, self.d2, self.d1 = discount(self.tri_n), discount(self.bi_n), discount(self.uni_n)
        self.ctx2, self.ctx2_sum, self.ctx2_kinds = _grouped(self.tri >> BITS, self.tri_n)
        self.ctx1, self.ctx1_sum, self.ctx1_kinds = _grouped(self.bi >> BITS, self.bi_n)
        self.total, self.alphabet = self.uni_n.sum(), max(1, alphabet)

    @staticmethod
    def _step(keys, table, counts, d, contexts, sums, kinds, ctx, lower):
        at, known = _find(table, keys)
        c, seen = _find(contexts, ctx)
        own = np.where(known, np.maximum(counts[at] - d, 0), 0) / sums[c]
        return np.where(seen, own + d * kinds[c] / sums[c] * lower, lower)

    def cost(self, grams: np.ndarray) -> np.ndarray:
        """-log p(last character | the two before) of trigram codes."""
        at, known = _find(self.uni, grams & ONE)
        p = np.where(known, np.maximum(self.uni_n[at] - self.d1, 0), 0) / self.total
        p = p + self.d1 * len(self.uni) / self.total / (self.alphabet + 1)
        p = self._step(grams & TWO, self.bi, self.bi_n, self.d2, self.ctx1, self.ctx1_sum, self.ctx1_kinds, (grams & TWO) >> BITS, p)
        p = self._step(grams, self.tri, self.tri_n, self.d3, self.ctx2, self.ctx2_sum, self.ctx2_kinds, grams >> BITS, p)
        return -np.log(p)


def train(counted: pd.DataFrame) -> tuple[list[str], list[Model]]:
    """The languages in order, and their models, from (lang, gram, n)."""
    alphabet = len(np.unique(counted["gram"].to_numpy(dtype=np.int64) & ONE))
    langs = sorted(counted["lang"].unique())
    tables = [counted[counted["lang"] == x] for x in langs]
    return langs, [Model(t["gram"].to_numpy(np.int64), t["n"].to_numpy(np.int64), alphabet) for t in tables]


def gram_costs(counted: DataFrame, needed: DataFrame, langs: list[str]) -> DataFrame:
    """(gram, costs) for every gram of ``needed``: its cost under each language, in the order of ``langs``.

    The model of :class:`Model`, as joins of its tables instead of arrays.
    """
    one, two = F.lit(ONE), F.lit(TWO)

    def contexts(df: DataFrame, out: str) -> DataFrame:
        key = F.shiftright("gram", BITS).alias("ctx")
        return df.groupBy("lang", key).agg(F.sum("n").alias(f"sum_{out}"), F.count(F.lit(1)).alias(f"kinds_{out}"))

    def cut(df: DataFrame, out: str) -> DataFrame:
        ones, twos = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        d = F.when(ones > 0, F.least(F.lit(0.95), F.greatest(F.lit(0.1), ones / (ones + 2 * twos)))).otherwise(0.5)
        return df.groupBy("lang").agg(d.alias(out), F.sum("n").alias(f"total_{out}"), F.count(F.lit(1)).alias(f"kinds_{out}"))

    tri = counted.select("lang", "gram", "n")
    bi = tri.groupBy("lang", F.col("gram").bitwiseAND(two).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    uni = bi.groupBy("lang", F.col("gram").bitwiseAND(one).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    alphabet = uni.agg(F.count_distinct("gram")).first()[0]
    cuts = cut(tri, "d3").join(cut(bi, "d2"), "lang").join(cut(uni, "d1"), "lang")
    df = needed.withColumn("lang", F.explode(F.array(*[F.lit(x) for x in langs]))).join(F.broadcast(cuts), "lang")  # a row a language
    df = df.withColumns({"g1": F.col("gram").bitwiseAND(one), "g2": F.col("gram").bitwiseAND(two)})
    df = df.withColumns({"c1": F.shiftright("g2", BITS), "c2": F.shiftright("gram", BITS)})
    for table, key, n in ((uni, "g1", "n1"), (bi, "g2", "n2"), (tri, "gram", "n3")):
        df = df.join(table.select("lang", F.col("gram").alias(key), F.col("n").alias(n)), ["lang", key], "left")
    for table, key, out in ((bi, "c1", "b"), (tri, "c2", "t")):
        df = df.join(contexts(table, out).withColumnRenamed("ctx", key), ["lang", key], "left")

    def own(n: str, d: str):
        return F.greatest(F.coalesce(n, F.lit(0)) - F.col(d), F.lit(0.0))

    p = own("n1", "d1") / F.col("total_d1") + F.col("d1") * F.col("kinds_d1") / F.col("total_d1") / (alphabet + 1)
    for n, d, out in (("n2", "d2", "b"), ("n3", "d3", "t")):
        total, kinds = F.col(f"sum_{out}"), F.col(f"kinds_{out}")
        p = F.when(total.isNotNull(), own(n, d) / total + F.col(d) * kinds / total * p).otherwise(p)
    costs = df.select("gram", "lang", (-F.ln(p)).alias("cost")).groupBy("gram").agg(F.collect_list(F.struct("lang", "cost")).alias("each"))
    return costs.select("gram", F.transform(F.array_sort("each"), lambda x: x["cost"]).alias("costs"))


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for row, text in zip(pdf["row"], pdf["text"], strict=True):
            c = codes(text)
            if c is not None:
                g, n = np.unique(trigrams(c), return_counts=True)
                yield pd.DataFrame({"row": row, "gram": g, "n": n})


def joined_costs(texts: DataFrame, counted: DataFrame, langs: list[str]) -> DataFrame:
    """``texts`` (doc_id, text, learnt) to (doc_id, learnt, size, costs) by joins, without a broadcast model."""
    numbered = materialize(texts.withColumn("row", F.monotonically_increasing_id()), "language-texts")
    held = materialize(numbered.select("row", "text").mapInPandas(_grams, "row long, gram long, n long"), "language-grams")
    known = gram_costs(counted, held.select("gram").distinct(), langs)
    sums = [F.sum(F.col("n") * F.get("costs", F.lit(k))).alias(f"c{k}") for k in range(len(langs))]
    each = held.join(known, "gram").groupBy("row").agg(F.sum("n").alias("size"), *sums)
    each = each.select("row", "size", F.array(*[F.col(f"c{k}") / F.col("size") for k in range(len(langs))]).alias("costs"))
    zero = F.array(*[F.lit(0.0) for _ in langs])
    return numbered.join(each, "row", "left").select(
        "doc_id", "learnt", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("costs", zero).alias("costs")
    )


def cross_entropies(texts: list[str | None], models: list[Model]) -> tuple[np.ndarray, np.ndarray]:
    """Mean cost of each text under each model, and the number of its trigrams (0: no letter)."""
    grams = [trigrams(c) if c is not None else np.empty(0, dtype=np.int64) for c in map(codes, texts)]
    sizes = np.array([len(g) for g in grams])
    out = np.zeros((len(texts), len(models)))
    if sizes.sum():
        found, at = np.unique(np.concatenate(grams), return_inverse=True)
        row = np.repeat(np.arange(len(texts)), sizes)
        for k, m in enumerate(models):
            out[:, k] = np.bincount(row, weights=m.cost(found)[at], minlength=len(texts))
        out /= np.maximum(sizes, 1)[:, None]
    return out, sizes


def identify(docs: DataFrame, train_on: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Languages of ``docs`` (doc_id, text, learnt), learnt from ``train_on`` (text, lang).

    ``learnt`` marks the rows that calibrate the rejection.

    Returns doc_id, lang_pred, score (0 to 1), cross_entropy and rejected. A
    null text, or one without a letter, is "und" with score 0. If there is
    nothing to learn from, every text is "und". Rows of ``train_on`` with a
    null lang are left out. Ties go to the first language by name. Each row is
    judged by itself, so repeated rows get equal results; very long texts are
    judged whole. Other columns, whatever their names, are ignored. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = train_on.where("lang IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counted = known.mapInPandas(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialize(counted, "language-counts")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())  # a row a language
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "learnt")
    if not langs:
        return slim.select(
            "doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("cross_entropy"), F.lit(True).alias("rejected")
        )
    if counted.count() <= model_rows:
        sent = spark.sparkContext.broadcast(train(counted.toArrow().to_pandas())[1])

        def costs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                found, sizes = cross_entropies([t if isinstance(t, str) else None for t in pdf["text"]], sent.value)
                learnt = (pdf["learnt"] == True).to_numpy()  # noqa: E712
                yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "learnt": learnt, "size": sizes, "costs": list(found)})

        table = slim.mapInPandas(costs, "doc_id long, learnt boolean, size long, costs array<double>")
    else:
        table = joined_costs(slim, counted, langs)
    low = F.array_min("costs")
    some = F.col("size") > 0
    share = 1 / F.aggregate("costs", F.lit(0.0), lambda a, c: a + F.exp(-SHARPNESS * (c - F.col("cross_entropy"))))
    table = table.withColumn("cross_entropy", F.when(some, low).otherwise(0.0))
    best = F.get(F.array(*[F.lit(x) for x in langs]), F.array_position("costs", low).cast("int") - 1)
    table = table.select(
        "doc_id", "learnt", "size", "cross_entropy",
        F.when(some, best).otherwise(UNDETERMINED).alias("lang_pred"), F.when(some, share).otherwise(0.0).alias("score"),
    )
    table = materialize(table, "languages")
    usual = table.where("learnt AND size >= 20").groupBy("lang_pred").agg(
        (F.avg("cross_entropy") + REJECT * F.coalesce(F.stddev_pop("cross_entropy"), F.lit(0.0))).alias("limit")
    )
    out = table.join(F.broadcast(usual), "lang_pred", "left")  # a row a language
    rejected = (F.col("lang_pred") == UNDETERMINED) | F.coalesce(F.col("cross_entropy") > F.col("limit"), F.lit(False))
    return out.select("doc_id", "lang_pred", "score", "cross_entropy", rejected.alias("rejected"))


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    train_on = docs.where(~held & F.col("doc_id").isNotNull())
    learnt = ~held & F.col("lang").isNotNull()
    found = identify(docs.select("doc_id", "text", learnt.alias("learnt")), train_on)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
