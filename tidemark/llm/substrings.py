"""Exact substring deduplication by fixed-block anchors.

A window of 50 words holds a whole one of its document's non-overlapping blocks
of 25 words, wherever it starts. So the blocks are indexed (a document's blocks
by their hash, with the smallest doc_id that has each), and every rolling window
of 25 words of every document probes the index: a passage of 50 words that a
document shares with one of a smaller id hits at least once. Around the hits, in
the documents that own the block and in those that probe it alike, the match is
extended word by word: each of the 50-word windows that contain the anchor gets
a 128-bit key of all its words, the windows of a key get the smallest doc_id
that has them, and neighbouring windows that a smaller document has too join to
the maximal repeats, which go. Documents are never paired with each other, so
a passage of a third of all documents costs each of them its own words only.

Whole copies (equal word sequences) are merged before the index is made. Which
rows are worth a shuffle is asked of broadcast filters of a bounded number of
bits, which hold every key there is; beyond their size they let more through,
and the joins behind them decide alone. Of the extended windows, short codes
go round first, and whole keys only of those that two documents may have.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize, small_batches

WINDOW = 50
#: Bits of a filter for each of its keys, and its most bits (32 MB).
KEY_BITS, MOST_BITS = 16, 1 << 28
#: Bytes of a word from which it is hashed by itself.
LONG_WORD = 64
#: Keys that a task holds before it sends them, and the most that a bucket of them is meant to get.
HELD_KEYS, BUCKET_KEYS = 1 << 21, 1 << 22
#: An odd number and its inverse modulo 2^64, for each of the two hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
TEXT = "doc_id long, sig long"
#: Numbers for the bytes, by rule.
BYTES = [(np.arange(1, 257, dtype=np.uint64) * np.uint64(b)) ** np.uint64(3) for b in BASES]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads each bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_places(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, where words start and stop among them, and the numbers of words before each text."""
    texts = column.cast(pa.large_binary()).fill_null(b"")
    edges = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[edges[0] : edges[-1]]
    edges = edges - edges[0]
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    # A word also ends with its text.
    turn = np.zeros(len(data) + 1, dtype=bool)
    turn[edges] = True
    before = np.concatenate([[False], solid])[: len(data)] & ~turn[:-1]
    after = np.concatenate([solid[1:], [False]])[: len(data)] & ~turn[1:]
    starts = np.flatnonzero(solid & ~before)
    return data, starts, np.flatnonzero(solid & ~after) + 1, np.searchsorted(starts, edges)


def word_hashes(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of every word: a column at a time over the words' bytes, longest words first."""
    from xxhash import xxh3_128_digest

    sizes = stops - starts
    out = np.empty((len(starts), 2), dtype=np.uint64)
    long = np.flatnonzero(sizes > LONG_WORD)
    for i in long.tolist():
        out[i] = np.frombuffer(xxh3_128_digest(data[starts[i] : stops[i]].tobytes()), dtype="<u8")
    short = np.flatnonzero(sizes <= LONG_WORD)
    short = short[np.argsort(-sizes[short].astype(np.int16), kind="stable")]
    at, ends = starts[short], np.searchsorted(-sizes[short], -np.arange(LONG_WORD + 1))
    h = [mixed(sizes[short].astype(np.uint64) + np.uint64(k)) for k in (1, 2)]
    for j in range(LONG_WORD):
        m = int(ends[j])
        if not m:
            break
        byte = data[at[:m] + j]
        for k in (0, 1):
            h[k][:m] *= np.uint64(BASES[k])
            h[k][:m] += BYTES[k][byte]
    for k in (0, 1):
        out[short, k] = mixed(h[k])
    return out


class Rolling:
    """Polynomial hashes modulo 2^64 of all runs of words of a batch of documents."""

    def __init__(self):
        self.powers: list[tuple[np.ndarray, np.ndarray]] = []

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where each text's words begin and end among all, and two hashes of every word."""
        data, starts, stops, edges = word_places(column)
        return edges, word_hashes(data, starts, stops)

    def _powers(self, which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.powers) <= which:
            self.powers.append((np.ones(1, dtype=np.uint64),) * 2)
        if len(self.powers[which][0]) < n:
            size = max(n, 1 << 16)
            both = []
            for base in (BASES[which], pow(BASES[which], -1, 1 << 64)):
                p = np.full(size, base, dtype=np.uint64)
                p[0] = 1
                both.append(np.multiply.accumulate(p))
            self.powers[which] = tuple(both)
        return self.powers[which]

    def runs(self, hashes: np.ndarray, length: int, which: int = 0) -> np.ndarray:
        """The hash of the ``length`` words from each place (those over a document's end are of no use)."""
        n = len(hashes)
        if n < length:
            return np.empty(0, dtype=np.uint64)
        up, down = self._powers(which, n)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes[:, which] * up[:n], dtype=np.uint64)])
        return (sums[length:] - sums[:-length]) * down[: n - length + 1]


def _inside(edges: np.ndarray, length: int) -> np.ndarray:
    """The places among all words where ``length`` words of one document begin."""
    sizes = np.diff(edges)
    last = np.repeat(edges[1:] - length, sizes)
    return np.flatnonzero(np.arange(edges[-1]) <= last)


def bit_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of a key in a filter of ``bits`` (a power of two) bits."""
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def held(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes the filter may hold."""
    one, two = bit_places(h, 8 * len(filter_))
    seen = (filter_[(one >> np.uint64(3)).astype(np.int64)] >> (one & np.uint64(7)).astype(np.uint8)) & 1
    return (seen & (filter_[(two >> np.uint64(3)).astype(np.int64)] >> (two & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)


def key_filter(spark: SparkSession, keys: DataFrame, n: int):
    """A broadcast filter of the long column ``h`` of ``keys`` (n rows): two bits a
    key, KEY_BITS a key while that is at most MOST_BITS, whatever the table's size.

    The bits are set by Spark's bitmap aggregates, by pieces of the filter; the
    driver joins the pieces.
    """
    bits = 1 << 15
    while bits < min(MOST_BITS, KEY_BITS * n):
        bits <<= 1
    low = F.col("h").bitwiseAND(F.lit(bits - 1))
    high = F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(bits - 1))
    # Spark numbers the pieces from 1 and the bits of each from 0.
    places = keys.select(F.explode(F.array(low, high)).alias("place")).select(
        F.expr("bitmap_bucket_number(place + 1)").alias("piece"), F.expr("bitmap_bit_position(place + 1)").alias("bit")
    )
    pieces = places.repartition("piece").groupBy("piece").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))
    out = np.zeros(bits // 8, dtype=np.uint8)
    for r in pieces.collect():
        at = (r["piece"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(r["bitmap"]), dtype=np.uint8)
    return spark.sparkContext.broadcast(out)


def _index(window: int):
    """Of each document: words, SHA-256 of them joined by spaces, and the hashes of its blocks."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            edges, hashes = rolling.words(batch.column("text"))
            runs = rolling.runs(hashes, block).view(np.int64)
            blocks = [runs[a : b - block + 1 : block] if b - a >= window else runs[:0] for a, b in zip(edges[:-1], edges[1:], strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("sig"), pa.array(np.diff(edges)),
                    pa.array([hashlib.sha256(b" ".join((t or b"").split())).hexdigest() for t in batch.column("text").to_pylist()], pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([runs[:0], *blocks]))),
                ],
                ["doc_id", "sig", "n_words", "sha", "blocks"],
            )

    return run


def _probe(window: int, known):
    """The hashes of the rolling windows that the index may hold, each once a document."""
    block = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            edges, hashes = rolling.words(batch.column("text"))
            at = _inside(edges, block)
            owner = np.searchsorted(edges, at, side="right") - 1
            long_enough = np.diff(edges)[owner] >= window
            at, owner = at[long_enough], owner[long_enough]
            if not len(at):
                continue
            h = rolling.runs(hashes, block)[at]
            hit = np.flatnonzero(held(known.value, h))
            rows = pa.array(owner[hit])
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[hit].view(np.int64)), batch.column("doc_id").take(rows), batch.column("sig").take(rows)], ["h", "doc_id", "sig"]
            )

    return run


def _candidates(rolling: Rolling, batch: pa.RecordBatch, window: int, known) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows that contain an anchor which the filter may hold: where they
    start among all words, their documents, the documents' edges, and the words' hashes."""
    block = window // 2
    edges, hashes = rolling.words(batch.column("text"))
    at, starts = _inside(edges, block), _inside(edges, window)
    if len(starts):
        anchors = at[held(known.value, rolling.runs(hashes, block)[at])]
        # A window holds the anchors that begin at most window - block words after it does.
        starts = starts[np.searchsorted(anchors, starts) < np.searchsorted(anchors, starts + (window - block), side="right")]
    return starts, np.searchsorted(edges, starts, side="right") - 1, edges, hashes


def short_codes(k: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket (the first ``bits`` bits) and 39 further bits of each key."""
    bucket = k >> np.uint64(64 - bits) if bits else np.zeros(len(k), dtype=np.uint64)
    return bucket, k & np.uint64((1 << 39) - 1)


def code_hash(bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
    mixed = (low * np.uint64(BASES[0])) ^ (bucket * np.uint64(BASES[1]))
    return mixed ^ (mixed >> np.uint64(29))


def _sightings(window: int, known, bits: int):
    """Short codes of the candidate windows, five bytes each, by bucket: a task
    sends a code once for many documents, with a mark if there was more than one."""

    def packed(keys: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((docs, keys))
        keys, docs = keys[order], docs[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        several = np.add.reduceat(np.concatenate([[False], (keys[1:] == keys[:-1]) & (docs[1:] != docs[:-1])]), np.flatnonzero(new)) > 0
        bucket, low = short_codes(keys[new], bits)
        five = (low | (several.astype(np.uint64) << np.uint64(39))).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist()
        blobs = [five[5 * a : 5 * b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]].astype(np.int64)), pa.array(blobs, pa.binary())], ["bucket", "codes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling, waiting, n, number = Rolling(), [], 0, 0
        for batch in batches:
            starts, owner, _, hashes = _candidates(rolling, batch, window, known)
            if len(starts):
                waiting.append((rolling.runs(hashes, window)[starts], owner + number))
                n += len(starts)
            number += batch.num_rows
            if n >= HELD_KEYS:
                yield packed(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting, n = [], 0
        if waiting:
            yield packed(*map(np.concatenate, zip(*waiting, strict=True)))

    return run


def _met_again(table: pa.Table) -> pa.Table:
    """The codes of one bucket that more than one document has, hashed for a filter."""
    flat = np.frombuffer(b"".join(table.column("codes").to_pylist()), dtype=np.uint8).reshape(-1, 5)
    wide = np.zeros((len(flat), 8), dtype=np.uint8)
    wide[:, :5] = flat
    codes = np.sort(wide.view("<u8")[:, 0] & np.uint64((1 << 39) - 1))
    marked = wide.view("<u8")[:, 0]
    marked = marked[marked >> np.uint64(39) == 1] & np.uint64((1 << 39) - 1)
    found = np.unique(np.concatenate([codes[1:][codes[1:] == codes[:-1]], marked]))
    bucket = np.full(len(found), table.column("bucket")[0].as_py(), dtype=np.uint64)
    return pa.table({"h": code_hash(bucket, found).view(np.int64)})


def _extend(window: int, known, seen, bits: int):
    """The candidate windows whose codes more than one document may have, with whole keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            starts, owner, edges, hashes = _candidates(rolling, batch, window, known)
            if not len(starts):
                continue
            k = rolling.runs(hashes, window)[starts]
            again = held(seen.value, code_hash(*short_codes(k, bits)))
            starts, owner, k = starts[again], owner[again], k[again]
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(k.view(np.int64)), pa.array(rolling.runs(hashes, window, 1)[starts].view(np.int64)),
                    batch.column("doc_id").take(rows), batch.column("sig").take(rows), pa.array((starts - edges[owner]).astype(np.int32)),
                ],
                ["k0", "k1", "doc_id", "sig", "at"],
            )

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, digests = [], []
            for text, starts in zip(batch.column("text").to_pylist(), batch.column("starts").to_pylist(), strict=True):
                words = (text or b"").split()
                depth = np.zeros(len(words) + 1, dtype=np.int64)
                starts = np.unique(np.array(starts, dtype=np.int64))
                depth[starts] += 1
                depth[starts + window] -= 1
                keep = np.cumsum(depth)[:-1] == 0
                removed.append(len(words) - int(keep.sum()))
                digests.append(hashlib.sha256(b" ".join(compress(words, keep.tolist()))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("sig"), pa.array(removed, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "sig", "n_removed", "kept_sha256"],
            )

    return run


def _maybe_held(known):
    """Rows whose key the filter may hold: an Arrow pass over (doc_id, sig, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy().view(np.uint64)
            rows = batch.filter(pa.array(held(known.value, h)))
            if rows.num_rows:
                yield rows.select(["doc_id", "sig", "text"])

    return run


def _row_key(doc_id: str = "doc_id", sig: str = "sig") -> Column:
    return F.xxhash64(doc_id, sig)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Words that repeat a smaller document's, of every row of ``docs`` (doc_id, text).

    Words are runs of anything but space and the characters 9 to 13, unchanged;
    a window is ``window`` (even) consecutive words of one document. A word goes
    if a window that covers it also starts in a document with a smaller doc_id;
    windows are judged on the input. Returns doc_id, n_words, n_removed and
    kept_sha256 (of the kept words joined by one space) a row. Null and empty
    texts and those of fewer words than the window keep all they have. Rows
    that share a doc_id don't repeat one another; rows with a null doc_id
    neither lose words nor make others lose any. Very long texts count whole.
    Other columns, whatever their names, are ignored. An empty table gives no
    rows. Equality of windows rests on 128 bits of hashes of their words.
    """
    if window < 2 or window % 2:
        raise ValueError("the window must be even")
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col("text").cast("string")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("sig"), text.cast("binary").alias("text"))
    marks = materialize(slim.mapInArrow(_index(window), f"{TEXT}, n_words long, sha string, blocks array<long>"), "substring-marks")
    # Equal word sequences are merged: the smallest id's row stands for all.
    long_ones = marks.where(F.col("doc_id").isNotNull() & (F.col("n_words") >= window))
    best = F.min(F.struct("doc_id", "sig")).alias("r")
    first = materialize(long_ones.groupBy("sha").agg(best).select("sha", "r.*"), "substring-first")
    pair = ["doc_id", "sig"]
    blocks = long_ones.join(first.select(*pair), pair, "left_semi").select("doc_id", F.explode("blocks").alias("h"))
    index = materialize(blocks.groupBy("h").agg(F.min("doc_id").alias("first")), "substring-index")
    texts = slim.where(F.col("doc_id").isNotNull())
    known = key_filter(spark, index, index.count())
    probes = texts.mapInArrow(_probe(window, known), f"h long, {TEXT}")
    hits = probes.join(first.select(*pair), pair, "left_semi").groupBy("h").agg(F.max("doc_id").alias("last"))
    hits = hits.join(index, "h").where("first < last").select("h")
    hits = materialize(hits, "substring-hits")
    anchors = key_filter(spark, hits, hits.count())
    words = marks.agg(F.sum("n_words")).first()[0] or 0
    bits = max(4, math.ceil(math.log2(words / BUCKET_KEYS))) if words else 4
    sent = texts.mapInArrow(_sightings(window, anchors, bits), "bucket long, codes binary")
    again = materialize(sent.groupBy("bucket").applyInArrow(_met_again, "h long"), "substring-again")
    seen = key_filter(spark, again, again.count())
    windows = materialize(texts.mapInArrow(_extend(window, anchors, seen, bits), f"k0 long, k1 long, {TEXT}, at int"), "substring-windows")
    owners = windows.groupBy("k0", "k1").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    owners = materialize(owners.drop("last"), "substring-owners")
    covered = windows.join(owners, ["k0", "k1"]).where(F.col("doc_id") > F.col("first"))
    covered = materialize(covered.groupBy(*pair).agg(F.collect_set("at").alias("starts")), "substring-covered")
    covering = key_filter(spark, covered.select(_row_key().alias("h")), covered.count())
    near = texts.select("*", _row_key().alias("h")).mapInArrow(_maybe_held(covering), f"{TEXT}, text binary")
    cut = near.join(covered, pair).mapInArrow(_cut(window), f"{TEXT}, n_removed long, kept_sha256 string")
    # Rows that share all are one here; the join below gives each its result.
    cut = materialize(cut.dropDuplicates(pair), "substring-cut")
    nothing = hashlib.sha256(b"").hexdigest()
    out = marks.select("doc_id", "sig", "n_words", "sha").join(first.select("sha", F.col("doc_id").alias("original")), "sha", "left")
    copy = F.col("original") < F.col("doc_id")
    out = out.join(cut, pair, "left")
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def op12_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents
), w AS MATERIALIZED (
  SELECT rid, doc_id, p, md5(array_to_string(words[p : p + {WINDOW - 1}], ' ')) AS k
  FROM (SELECT rid, doc_id, words, unnest(range(1, len(words) - {WINDOW - 2})) AS p FROM d)
), covered AS (
  SELECT DISTINCT rid, p + o AS p FROM (SELECT w.rid, w.p FROM w JOIN (SELECT k, min(doc_id) AS first FROM w GROUP BY k) f ON f.k = w.k WHERE w.doc_id > f.first),
         (SELECT unnest(range({WINDOW})) AS o)
), cells AS (SELECT rid, unnest(words) AS x, generate_subscripts(words, 1) AS p FROM d),
kept AS (SELECT c.rid, string_agg(c.x, ' ' ORDER BY c.p) AS s, count(*) AS n FROM cells c LEFT JOIN covered v ON v.rid = c.rid AND v.p = c.p WHERE v.rid IS NULL GROUP BY c.rid)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.s, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.rid = d.rid"""
