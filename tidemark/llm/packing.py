"""Packing of documents into fixed-length sequences by linear grouping.

Only the histogram of piece lengths (at most ``capacity`` counters) reaches
the driver. Large lengths are rounded up within groups of equal cardinality;
a configuration programme over those few sizes is solved by column generation
and rounded down, and actual lengths take the rounded ones' places. What
rounding leaves is grouped and solved again while that helps; the rest, and the
small lengths, go longest first to the fullest sequence that has room (best
fit). From which length on pieces count as large is tried for a few shares of
the capacity.
All of this works on counts of equal sequences, so its cost does not depend
on the number of documents. The resulting plan, a bounded table of (length,
rank) intervals, gives each piece its sequence and offset in parallel.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import bucket_count, bucketed_rank, materialize, small_batches
from .tokens import encoder, tokenizer_path

CAPACITY = 2048
END_ID = 0
#: Equal-cardinality groups of large lengths, and the shares of the capacity beyond which a length may count as large.
GROUPS = 96
SMALL_SHARES = (0.2, 0.3, 0.4, 0.5)
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def _tokenize(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc, end = encoder(tokenizer_path(tokenizer)), np.array([end_id], dtype="<u4").tobytes()
        width = 4 * capacity
        for pdf in batches:
            rows = []
            texts = [t if isinstance(t, str) else "" for t in pdf["text"]]
            for doc_id, ids in zip(pdf["doc_id"], enc.encode_batch(texts), strict=True):
                ids += end
                for k in range(0, len(ids), width):
                    part = ids[k : k + width]
                    rows.append((doc_id, k // width, k // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    return run


class Plan:
    """Counts of sequences by their content (a tuple of lengths), with a best-fit index of free room."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.by_room: dict[int, dict[tuple[int, ...], int]] = {}
        self.rooms: list[int] = []

    def add(self, content: tuple[int, ...], count: int) -> None:
        room = self.capacity - sum(content)
        if room not in self.by_room:
            self.by_room[room] = {}
            insort(self.rooms, room)
        kinds = self.by_room[room]
        kinds[content] = kinds.get(content, 0) + count

    def place(self, length: int, count: int) -> None:
        """Best fit of ``count`` pieces of ``length``: the fullest sequences with room, else new ones."""
        while count:
            at = bisect_left(self.rooms, length)
            if at == len(self.rooms):
                fit = self.capacity // length
                full, rest = divmod(count, fit)
                if full:
                    self.add((length,) * fit, full)
                if rest:
                    self.add((length,) * rest, 1)
                return
            room = self.rooms[at]
            kinds = self.by_room[room]
            content, bins = kinds.popitem()
            if not kinds:
                del self.by_room[room], self.rooms[at]
            # Equal pieces go on filling the same sequence while they fit.
            each = min(room // length, count)
            used = min(bins, count // each)
            if used < bins:
                self.add(content, bins - used)
            self.add(content + (length,) * each, used)
            count -= used * each

    def sequences(self) -> list[tuple[tuple[int, ...], int]]:
        return sorted((c, n) for kinds in self.by_room.values() for c, n in kinds.items())


def _best_pattern(sizes: list[int], prices: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The dearest set of at most ``most`` sizes (repeats allowed) that fits: its price and counts.

    Large sizes allow few pieces a sequence, so the knapsack is ``most`` rounds over all capacities at once.
    """
    best, picks = np.zeros(capacity + 1), []
    for _ in range(most):
        more, pick = best.copy(), np.full(capacity + 1, -1)
        for i, (s, price) in enumerate(zip(sizes, prices, strict=True)):
            value = best[: capacity + 1 - s] + price
            better = value > more[s:] + 1e-12
            more[s:][better], pick[s:][better] = value[better], i
        best = more
        picks.append(pick)
    column, c = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        i = pick[c]
        if i >= 0:
            column[i] += 1
            c -= sizes[i]
    return float(best[capacity]), column


def configurations(sizes: list[int], demand: list[float], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Solve min sum x over patterns p with sum x_p p = demand, by column
    generation: (pattern, x) pairs. ``sizes`` descend. Pricing is a knapsack of
    ``capacity`` with few pieces; stopping early only makes a plan less tight."""
    m, most = len(sizes), capacity // sizes[-1]
    basis = np.diag([float(capacity // s) for s in sizes])
    x = np.array(demand, dtype=float) / np.diag(basis)
    inverse = np.diag(1 / np.diag(basis))
    for k in range(rounds):
        if k % 50 == 49:
            inverse = np.linalg.inv(basis)  # the updates below gather rounding errors
        value, column = _best_pattern(sizes, inverse.sum(axis=0), capacity, most)
        if value <= 1 + 1e-6:
            break
        step = inverse @ column
        ratios = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratios))
        theta = ratios[out]
        x = np.maximum(x - theta * step, 0)
        x[out] = theta
        basis[:, out] = column
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
    return [(basis[:, i].astype(int), float(x[i])) for i in range(m) if x[i] > 0]


def linear_grouping(counts: dict[int, int], capacity: int, groups: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """One round of the scheme over large lengths: sequences, and the lengths they leave over.

    Runs of neighbouring lengths of about equal cardinality are groups, and a
    group's longest length is its size. The programme over the sizes is rounded
    down, and each slot takes the longest length left of its group.
    """
    share, filled = sum(counts.values()) / groups, 0.0
    members: list[list[list[int]]] = [[]]
    for s in sorted(counts, reverse=True):
        if members[-1] and (filled >= share * len(members) or len(counts) <= groups):
            members.append([])
        members[-1].append([s, counts[s]])
        filled += counts[s]
    demand = [float(sum(n for _, n in g)) for g in members]
    made = []
    for pattern, times in configurations([g[0][0] for g in members], demand, capacity):
        bins = int(times + 1e-6)
        slots = [g for g, k in enumerate(pattern) for _ in range(k)]
        while bins:
            # As many equal sequences at once as the lengths at the heads of the groups allow.
            heads: dict[int, int] = {}
            for g in slots:
                heads[g] = heads.get(g, 0) + 1
            run = min([bins, *(members[g][0][1] // k for g, k in heads.items() if members[g])])
            content = []
            for g in slots:
                if members[g]:
                    content.append(members[g][0][0])
                    members[g][0][1] -= max(run, 1)
                    if not members[g][0][1]:
                        members[g].pop(0)
            if not content:
                break
            made.append((tuple(content), max(run, 1)))
            bins -= max(run, 1)
    return made, {s: n for g in members for s, n in g}


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (lengths in order, how many such) that hold exactly ``counts`` (length to number).

    Linear grouping is done with each of the cut-offs between small and large
    lengths; the plan with the fewest sequences is taken, on a tie the one that
    groups the most lengths.
    """
    left = {s: n for s, n in counts.items() if n}
    plans = []
    for share in SMALL_SHARES:
        plan, rest = Plan(capacity), dict(left)
        if capacity in rest:
            plan.add((capacity,), rest.pop(capacity))
        own, before = {s: n for s, n in rest.items() if s > share * capacity}, math.inf
        for s in own:
            del rest[s]
        while len(own) > 1 and sum(own.values()) < before / 2:
            before = sum(own.values())
            made, own = linear_grouping(own, capacity, groups)
            for content, n in made:
                plan.add(content, n)
        rest |= own
        for s in sorted(rest, reverse=True):
            plan.place(s, rest[s])
        plans.append(plan.sequences())
    return min(plans, key=lambda p: sum(n for _, n in p))


def plan_table(sequences: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """Rank intervals: pieces of ``length`` ranked from ``rank`` on take ``sequence`` onwards at ``offset``."""
    ranks: dict[int, int] = {}
    rows, first = [], 0
    for content, count in sequences:
        offset = 0
        for length in content:
            at = ranks.get(length, 0)
            rows.append((length, at, first, offset))
            ranks[length] = at + count
            offset += length
        first += count
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "offset"], dtype=np.int64).sort_values(["length", "rank"])


def _assign(plan):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        length, rank, sequence, offset = plan.value
        starts = {int(s): int(i) for s, i in zip(*np.unique(length, return_index=True), strict=True)}
        ends = {int(s): int(i) for s, i in zip(*np.unique(length[::-1], return_index=True), strict=True)}
        for pdf in batches:
            at = np.empty(len(pdf), dtype=np.int64)
            lengths, ranks = pdf["length"].to_numpy(), pdf["rank"].to_numpy()
            for s in np.unique(lengths):
                rows = lengths == s
                a, b = starts[int(s)], len(length) - ends[int(s)]
                at[rows] = a + np.searchsorted(rank[a:b], ranks[rows], side="right") - 1
            pdf["sequence_id"] = sequence[at] + ranks - rank[at]
            pdf["offset"] = offset[at]
            yield pdf.drop(columns="rank")

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str = "word_bpe_49k.json", capacity: int = CAPACITY, end_id: int = END_ID, groups: int = GROUPS
) -> DataFrame:
    """Pack the documents (doc_id, text; others ignored) into sequences.

    A document's ids are its text's ids and ``end_id`` (null or empty text: the
    end id alone). Longer ones than ``capacity`` are cut into full pieces and a
    rest. Returns per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id (gapless from 0), offset. Repeated rows and repeated or null
    doc_ids are packed as rows of their own; pieces of equal length may take
    one another's places from run to run. Very long texts are cut like any
    other. Other columns, whatever their names, are ignored. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = materialize(slim.mapInPandas(_tokenize(tokenizer, capacity, end_id), PIECES), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = plan_table(pack_histogram(counts, capacity, groups))
    plan = spark.sparkContext.broadcast(tuple(table[c].to_numpy() for c in table.columns))
    buckets = bucket_count(max(counts.values(), default=0))
    # Pieces are told apart by their place in the written table, so no key, however hot, is one bucket.
    place = ["_file", "_row"]
    keyed = pieces.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    keyed = keyed.withColumn("_b", F.pmod(F.xxhash64(*place), F.lit(buckets)))
    ranked = bucketed_rank(keyed, ["length"], "_b", place, "rank").drop("_b", *place)
    return ranked.mapInPandas(
        _assign(plan),
        "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long",
    )


def op7_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def packing_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack whatever documents are left, as :func:`pack_documents` does: one row per piece.

    Null and empty texts are a piece of one id, repeated rows are packed each,
    very long texts are cut; an empty table gives no rows.
    """
    return pack_documents(docs)
