"""SimHash near-duplicates with bit-sliced fingerprint comparison.

Documents with equal fingerprints are merged first, so copies never meet one
another. Distinct fingerprints within ``radius`` bits agree on all of some
``blocks - radius`` of ``blocks`` bit ranges (pigeonhole), so each is filed
under every such choice of ranges and compared inside its buckets only. That
finds every link. In a bucket the fingerprints are stored as vertical bit
planes: one XOR handles 64 pairs a word, carry-save counters add the planes
up, and a block of lanes is abandoned once every lane is past the radius.
A bucket yields a spanning forest of its links rather than all its pairs. One of
too many fingerprints is filed again under ranges of the bits that it doesn't
share yet, by the same argument, so a hot bucket costs a few copies of its rows
and is never compared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, materialize, small_batches

RADIUS = 3
SEED = 42
#: Lanes that are dropped together (64 words of 64 lanes).
BLOCK_WORDS = 64
#: Buckets above this many fingerprints are filed again under further ranges.
BUCKET_ROWS = 4096
#: With so few bits not shared, a bucket of distinct fingerprints is small anyway.
LAST_BITS = 12
#: Buckets up to this size are compared many at a time, lane against shifted lane.
SMALL_BUCKET = 64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash of a text (null: as empty), as a signed long.

    ASCII letters are lower-cased, words are runs of non-white-space, and every
    occurrence of a shingle counts. Fewer words than ``shingle`` form one
    shingle; no words give zero.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-shingle].tolist()]
        stops = (ends[shingle - 1 :] - 1).tolist()
        hashes = [xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i : i + 65_536], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())
    return value - (1 << 64) if value >= 1 << 63 else value


def _fingerprints(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame({"doc_id": pdf["doc_id"], "fp": np.array([fingerprint(t) for t in pdf["text"]], dtype=np.int64)})


def vertical(fps: np.ndarray) -> np.ndarray:
    """Bit planes of ``fps``: row b holds bit b of every lane, 64 lanes a word."""
    n = len(fps)
    bits = np.unpackbits(np.ascontiguousarray(fps, dtype="<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, -(-max(n, 1) // 64) * 64), dtype=np.uint8)
    padded[:, :n] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def lanes_within(diff, words: int, valid: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose number of set difference bits is at most ``radius``.

    ``diff(bit, at)`` gives the difference plane of a bit for the words ``at``.
    Counters are carry-save: counter k holds bit k of every lane's distance.
    Blocks whose valid lanes have all overflowed are abandoned at every eighth plane.
    """
    depth = max(1, radius.bit_length())
    at = np.arange(words)
    counters = [np.zeros(words, dtype=np.uint64) for _ in range(depth)]
    dead = ~valid
    for bit in range(64):
        carry = diff(bit, at)
        for k in range(depth):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        dead = dead | carry
        if bit % 8 == 7 and bit < 63:
            live = ~dead != 0
            if not live.any():
                return np.empty(0, dtype=np.int64)
            if len(at) > BLOCK_WORDS:
                blocks = np.logical_or.reduceat(live, np.arange(0, len(at), BLOCK_WORDS))
                keep = np.repeat(blocks, BLOCK_WORDS)[: len(at)]
            else:
                keep = live
            if not keep.all():
                at, dead, counters = at[keep], dead[keep], [c[keep] for c in counters]
    found = np.flatnonzero(np.unpackbits((~dead).view(np.uint8), bitorder="little"))
    if not len(found):
        return found
    word, lane = at[found // 64], found % 64
    distance = sum(((c[found // 64] >> lane.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << k for k, c in enumerate(counters))
    return (word * 64 + lane)[distance <= radius]


def _mask(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-max(len(flags), 1) // 64) * 64, dtype=np.uint8)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def _shifted(plane: np.ndarray, by: int) -> np.ndarray:
    """Lane i of the result is lane i + by of ``plane``."""
    skip, bits = divmod(by, 64)
    out = np.zeros_like(plane)
    rest = plane[skip:]
    out[: len(rest)] = rest >> np.uint64(bits)
    if bits and len(rest) > 1:
        out[: len(rest) - 1] |= rest[1:] << np.uint64(64 - bits)
    return out


def link_small(fps: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Linked index pairs of equal ``group`` (sorted), comparing lane i with lane i + d for every d."""
    planes, links = vertical(fps), []
    _, sizes = np.unique(group, return_counts=True)
    for d in range(1, int(sizes.max(initial=1))):
        flags = np.zeros(len(fps), dtype=np.uint8)
        flags[:-d] = group[:-d] == group[d:]
        if not flags.any():
            break
        moved: dict[int, np.ndarray] = {}

        def diff(bit, at, d=d, moved=moved):
            if bit not in moved:
                moved[bit] = planes[bit] ^ _shifted(planes[bit], d)
            return moved[bit][at]

        links += [(int(i), int(i) + d) for i in lanes_within(diff, planes.shape[1], _mask(flags), radius)]
    return links


def link_large(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``fps``: breadth-first search in
    which a pivot is compared with all lanes not reached yet."""
    planes, n = vertical(fps), len(fps)
    waiting = np.ones(n, dtype=np.uint8)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    links = []
    for start in range(n):
        if not waiting[start]:
            continue
        waiting[start] = 0
        frontier = [start]
        while frontier:
            pivot = frontier.pop()
            left = _mask(waiting)
            used = np.flatnonzero(left)
            if not len(used):
                break
            own = int(fps[pivot])

            def diff(bit, at, own=own, used=used):
                plane = planes[bit][used[at]]
                return plane ^ full if own >> bit & 1 else plane

            for lane in lanes_within(diff, len(used), left[used], radius):
                i = int(used[lane // 64] * 64 + lane % 64)
                waiting[i] = 0
                frontier.append(i)
                links.append((pivot, i))
    return links


def forest(links: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those links that join what the earlier ones left apart."""
    parent: dict[int, int] = {}

    def root(x):
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(up, up)
        return x

    kept = []
    for a, b in links:
        ra, rb = root(a), root(b)
        if ra != rb:
            parent[rb] = ra
            kept.append((a, b))
    return kept


def _compare(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows come sorted by bucket; a bucket may go on in the next batch.
        rest = None
        for pdf in batches:
            if rest is not None and len(rest):
                pdf = pd.concat([rest, pdf], ignore_index=True)
            keys = pdf[["mask", "key"]].to_numpy()
            new = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            cut = int(new[-1]) if len(new) else 0
            rest = pdf.iloc[cut:]
            if cut:
                yield _links(pdf.iloc[:cut], new, radius)
        if rest is not None and len(rest):
            keys = rest[["mask", "key"]].to_numpy()
            yield _links(rest, np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, radius)

    return run


def _links(pdf: pd.DataFrame, new: np.ndarray, radius: int) -> pd.DataFrame:
    fps, ids = pdf["fp"].to_numpy().astype(np.uint64), pdf["id"].to_numpy()
    starts = np.concatenate([[0], new[new < len(pdf)]])
    sizes = np.diff(np.append(starts, len(pdf)))
    group = np.repeat(np.arange(len(starts)), sizes)
    links = []
    small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL_BUCKET), sizes))
    if len(small):
        links += [(int(small[a]), int(small[b])) for a, b in link_small(fps[small], group[small], radius)]
    for g in np.flatnonzero(sizes > SMALL_BUCKET):
        a = int(starts[g])
        links += [(a + x, a + y) for x, y in link_large(fps[a : a + int(sizes[g])], radius)]
    links = forest(links)
    return pd.DataFrame({"a": ids[[x for x, _ in links]], "b": ids[[y for _, y in links]]}, dtype=np.int64)


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def bucket_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks that file ``n`` fingerprints: two within ``radius`` agree under one of them.

    More ranges make longer keys under more masks; the fewest ranges are taken
    whose keys leave some 32 fingerprints a bucket.
    """
    blocks = radius + 1
    while blocks < radius + 4 and n / 2 ** (64 * (blocks - radius) / blocks) > 32:
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    ranges = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(blocks)]
    masks = [sum(ranges[i] for i in chosen) for chosen in combinations(range(blocks), blocks - radius)]
    assert len(masks) == comb(blocks, radius)
    return masks


def finer_masks(mask: int, radius: int = RADIUS) -> list[int]:
    """``mask`` with one more range each of the bits outside it: two fingerprints
    that agree on ``mask`` and are within ``radius`` agree under one of them too."""
    free = [b for b in range(64) if not mask >> b & 1]
    if len(free) <= max(LAST_BITS, radius + 1):
        return []
    edges = [round(len(free) * i / (radius + 1)) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(edges[:-1], edges[1:], strict=True)]


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints (id long, fp long) within ``radius`` bits."""
    waiting, masks, links = fps.select("id", "fp"), bucket_masks(fps.count(), radius), None
    keys = ["mask", "key"]
    filed = waiting.select("id", "fp", F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"))
    while True:
        filed = filed.withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        sizes = filed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        finer = {_signed(m): [_signed(x) for x in finer_masks(m, radius)] for m in masks}
        split = [m for m, more in finer.items() if more]
        hot = (F.col("n") > bucket_rows) & F.col("mask").isin(split)
        sizes = materialize(sizes.withColumn("hot", hot), "simhash-buckets")
        dealt = filed.join(sizes.where("NOT hot").select(*keys), keys)
        found = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_compare(radius), "a long, b long")
        links = found if links is None else links.unionByName(found)
        again = [r["mask"] for r in sizes.where("hot").select("mask").distinct().collect()]  # masks, not rows
        if not again:
            return links
        into = F.create_map(*[F.lit(x) for m in again for x in (m, finer[m])])
        # The same wider mask may be reached on two ways.
        filed = filed.join(sizes.where("hot").select(*keys), keys).select("id", "fp", F.explode(F.element_at(into, F.col("mask"))).alias("mask"))
        filed = materialize(filed.distinct(), "simhash-hot")
        masks = sorted({x % (1 << 64) for m in again for x in finer[m]})


def simhash_components(docs: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Fingerprint and near-duplicate component of every document.

    Reads doc_id and text; returns doc_id, fp (signed long), component_id (the
    smallest doc_id reachable over links of at most ``radius`` bits). Texts
    without words (null, empty, white space) have fingerprint zero and link
    like any others; very long texts count whole. Rows with a null doc_id get a
    null component_id and link nothing. Repeated doc_ids are kept as rows, and
    the id ties the components of its texts. Components have no ties: the
    smallest id names them. Other columns, whatever their names, are ignored.
    An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = materialize(slim.mapInPandas(_fingerprints, "doc_id long, fp long"), "simhash")
    known = marked.where("doc_id IS NOT NULL")
    roots = materialize(known.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-roots")
    # A repeated doc_id may carry two fingerprints; the id itself then ties them.
    pairs = fingerprint_links(roots, radius, bucket_rows)
    several = known.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo <> hi").select("doc_id")
    tied = known.join(several, "doc_id").join(roots, "fp").select(F.col("id").alias("a"), F.col("doc_id").alias("b"))
    merged = components(pairs.union(tied))
    labelled = roots.join(merged, roots["id"] == merged["node"], "left").select(
        "fp", F.coalesce("component", "id").alias("component_id")
    )
    labelled = materialize(labelled, "simhash-labels")
    out = marked.join(labelled, "fp", "left")
    return out.select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    )


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return found.select("doc_id", hexed, "component_id")


def simhash_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each near-duplicate component: the smallest doc_id.

    Where rows share that id, one of those whose text has the smallest hash
    stays. Null, empty and white-space texts are copies of one another. Rows
    with a null doc_id link nothing and all stay. Columns of any name pass
    through; an empty table stays empty.
    """
    found = simhash_components(docs)
    key = docs["doc_id"].cast("long")
    ids = found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("component_id").alias("to"))
    marks = materialize(ids.where("doc_id <> to OR n > 1"), "simhash-marks")
    once = docs.join(marks, key == marks["doc_id"], "left_anti")
    repeated = marks.where("doc_id = to").select(F.col("doc_id").alias("id"))
    if repeated.isEmpty():
        return once
    named = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.join(repeated, key == repeated["id"], "left_semi").toDF(*named.values())
    rows = rows.withColumn("own", F.col(named["doc_id"]).cast("long")).withColumn("h", F.xxhash64(named["text"]))
    first = rows.groupBy(F.col("own").alias("to")).agg(F.min("h").alias("least"))
    rows = rows.join(first, (F.col("own") == F.col("to")) & (F.col("h") == F.col("least"))).dropDuplicates(["own"])
    return once.union(rows.select(*[F.col(named[c]).alias(c) for c in docs.columns]))
