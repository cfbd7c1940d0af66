"""Benchmark decontamination: short test items inside long documents.

Containment of an item in a document is the share of the item's distinct word
shingles that the document holds. Items are partitioned by size (powers of
two). An item's MinHash sketch is the k of its shingles that have the least
hash values (bottom-k); k follows from its partition's largest size. As in
containment MinHash, only the small set is sketched, and the share of a sketch
that a document holds estimates the containment whatever the document's length.
k - m of the sketch is asked for, where m is how many shingles a qualifying
document may lack, so no qualifying pair is lost to chance, and no document is
compared to every item. The pairs found are verified by exact shingle
containment.

Everything runs on DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

SHINGLE = 5
THRESHOLD = 0.8
#: Sketch shingles beyond those that a qualifying document may lack.
SPARE = 3
#: The sketch index is broadcast up to this many rows (16 bytes each), else joined by shuffle.
BROADCAST_ROWS = 1_000_000
NOT_WORD = "[^\\p{L}\\p{N}\\p{M}]+"


def words(text: Column) -> Column:
    """Lower-case runs of letters, marks and digits (null: none)."""
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), NOT_WORD), "")


def windows(items: str, width: int, each) -> Column:
    """``each`` of every run of ``width`` neighbours in the array column ``items``."""
    n = F.size(items)
    runs = F.transform(F.sequence(F.lit(0), n - width), each)
    return F.when(n >= width, runs).otherwise(F.slice(F.transform(F.sequence(F.lit(0), F.lit(0)), each), 1, 0))


def shingle_hashes(hashes: str, width: int) -> Column:
    """Hashes of the shingles of ``width`` words, from the width and the words' own hashes."""
    return windows(hashes, width, lambda i: F.xxhash64(F.lit(width), *[F.get(hashes, i + k) for k in range(width)]))


def shingle_texts(tokens: str, width: int) -> Column:
    return windows(tokens, width, lambda i: F.concat_ws(" ", F.slice(F.col(tokens), i + 1, width)))


def _choose(width: str, make) -> Column:
    """Shingles of the width that each row's column ``width`` names."""
    out = make(SHINGLE)
    for k in range(1, SHINGLE):
        out = F.when(F.col(width) == k, make(k)).otherwise(out)
    return out


def item_sketches(items: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Items (item_id, key, width, shingles, n, missing) and their sketch rows (key, width, hash, least).

    ``key`` names an item's words: texts that share an id are sketched apart,
    and equal texts of several ids once.
    """
    base = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0).distinct()
    base = base.withColumn("width", F.least(F.size("w"), F.lit(SHINGLE)))
    base = base.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    base = base.select(
        "item_id",
        F.xxhash64("w").alias("key"),
        "width",
        F.array_distinct(_choose("width", lambda k: shingle_texts("w", k))).alias("shingles"),
        F.array_distinct(_choose("width", lambda k: shingle_hashes("h", k))).alias("hashes"),
    ).withColumn("n", F.size("shingles"))
    # Rounded first: 0.8 x 15 must need 12 shingles, not 13.
    base = base.withColumn("missing", F.col("n") - F.ceil(F.round(F.col("n") * F.lit(threshold), 9)).cast("int"))
    base = materialize(base, "items")
    largest = F.pow(F.lit(2.0), F.floor(F.log2("n")) + 1) - 1
    length = (F.floor(largest * (1 - threshold)) + 1 + SPARE).cast("int")
    texts = base.select("key", "width", "n", "missing", "hashes").distinct()
    # The k least hash values of a uniform hash, whatever the order of the shingles.
    sketch = F.slice(F.array_sort("hashes"), F.lit(1), F.greatest(length, F.lit(1)))
    rows = texts.select("key", "width", "n", "missing", length.alias("k"), F.explode(sketch).alias("hash"))
    least = F.greatest(F.least("k", "n") - F.col("missing"), F.lit(1)).alias("least")
    return base, materialize(rows.select("key", "width", "hash", least), "sketches")


def contained_items(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and an item of which it holds at least ``threshold``.

    ``docs``: doc_id, text; ``items``: item_id, text. Returns doc_id, item_id,
    n_shingles, n_shared, containment. Shingles are five words; an item of
    fewer words is one shingle of all of them, looked for at that width. Items
    and documents without words (null, empty, signs only) match nothing; very
    long texts are searched whole. Rows that share an id count as found when
    one of them is; null ids are kept. Of equally contained texts of one
    item_id the one with more shingles is reported. Other columns, whatever
    their names, are ignored. An empty table gives no rows.
    """
    base, sketches = item_sketches(items.select("item_id", "text"), threshold)
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    small = sketches.count() <= BROADCAST_ROWS
    widths = sorted(r["width"] for r in sketches.select("width").distinct().collect())  # 1 to 5
    # One pass over the documents; a hash says how wide its shingle is.
    hashed = slim.select("doc_id", F.transform(words(F.col("text")), lambda x: F.xxhash64(x)).alias("h"))
    held = F.concat(*[shingle_hashes("h", k) for k in widths]) if widths else F.array().cast("array<bigint>")
    held = hashed.select("doc_id", F.explode(held).alias("hash"))
    # Beyond the limit a common passage is a hot key of the documents' side alone, which adaptive execution splits.
    own = sketches.drop("width")
    hits = held.join(F.broadcast(own) if small else own, "hash")
    found = hits.groupBy("doc_id", "key", "least").agg(F.count_distinct("hash").alias("held"))
    found = materialize(found.where("held >= least").select("doc_id", "key").distinct(), "candidates")
    # Exact: the shingles themselves, of the candidate documents only.
    named = found.select(F.col("doc_id").alias("found_id"), F.col("key").alias("found_key"))
    texts = slim.join(named, F.col("doc_id").eqNullSafe(F.col("found_id")))
    texts = texts.withColumn("w", words(F.col("text"))).drop("text")
    pairs = texts.join(base.drop("hashes"), F.col("key") == F.col("found_key"))
    held = _choose("width", lambda k: shingle_texts("w", k))
    pairs = pairs.withColumn("n_shared", F.size(F.array_intersect("shingles", held)))
    pairs = pairs.where(F.col("n_shared") >= F.col("n") - F.col("missing"))
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("n_shared") / F.col("n"), "n_shared", "n")).alias("b"))
    return best.select(
        "doc_id",
        "item_id",
        F.col("b.n").cast("int").alias("n_shingles"),
        F.col("b.n_shared").cast("int").alias("n_shared"),
        F.round(F.col("b.n_shared") / F.col("b.n"), 6).alias("containment"),
    )


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\p{M}]+'), lambda x: x <> '') AS w
  FROM documents
), i AS (
  SELECT item_id, w, least(len(w), 5) AS k FROM (
    SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}\\p{M}]+'), lambda x: x <> '') AS w
    FROM benchmark
  ) WHERE len(w) > 0
), i_s AS (
  SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM i)
), n AS (
  SELECT item_id, count(*) AS n FROM i_s GROUP BY item_id
), d_s AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p
        FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
), m AS (
  SELECT doc_id, item_id, count(*) AS n_shared FROM d_s JOIN i_s USING (k, s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, CAST(n AS INTEGER) AS n_shingles, CAST(n_shared AS INTEGER) AS n_shared,
       round(n_shared / n, 6) AS containment
FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(round(0.8 * n, 9))
"""


def decontamination_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that contain a benchmark item.

    Null, empty and wordless texts contain nothing and stay. Rows that share a
    doc_id (null too) are judged together and go when one of them does. Very
    long texts are searched whole; columns of any name pass through; an empty
    table stays empty.
    """
    found = contained_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaky = found.select(F.col("doc_id").alias("leaky")).distinct()
    return docs.join(leaky, docs["doc_id"].eqNullSafe(leaky["leaky"]), "left_anti")
