"""Near-duplicate vectors by a pivot-permutation index.

Equal vectors of a label are merged first. A vector is described by its
permutation: its ``prefix`` nearest pivots in order. It is filed in the inverted
lists of the first ``lists`` of them. Two vectors of one list are candidates by
their permutations: shared pivots count the more, the nearer their places are,
and the count must reach ``shared`` pivots at equal places (or the two have a
pivot in common that is near to both); cosine in double precision then decides.
A list is taken block against block: shared pivots are counted first, for all
rows at once, and cosines are taken of the candidates. A pair is
decided in the first list that both are in, so links are counted without being
written out; each block writes the number of links of its rows and a spanning
forest of them.

Pivots are a sample of 8 sqrt(n) of the n vectors at most, chosen by hash, of
which up to 2 sqrt(n) are kept so that none is near another; every vector is
indexed. Near means within twice the angle of a link, so a group of near copies
has one pivot, however large its share of the vectors is, and all its members
meet in that pivot's list. Lists thus grow like sqrt(n); one that is longer than
a block is dealt out as pairs of blocks, which loses nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.window import Window

from .common import components, materialize, small_batches

COSINE = 0.93
PREFIX = 8
LISTS = 4
SHARED = 1.5
#: Rows of a list that are compared at once; longer lists are dealt out as pairs of blocks.
LIST_ROWS = 4096
TILE = 512
#: Share of a tile's pairs from which their cosines are taken by one matrix product.
DENSE = 0.05


def pivot_count(n: int) -> int:
    return int(max(16, 2 * math.sqrt(n)))


def near_cosine(cosine: float) -> float:
    """The cosine of twice the angle whose cosine is ``cosine``: two links of one vector are that close."""
    return 2 * cosine * cosine - 1 if cosine > 0 else -1.0


def apart(candidates: list, count: int, near: float) -> np.ndarray:
    """The first ``count`` unit vectors of ``candidates`` of which none has a cosine of ``near`` or more with an earlier one."""
    rows = np.array(candidates, dtype=np.float64)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    kept = np.empty((min(count, len(rows)), rows.shape[1]))
    n = 0
    for row in rows:
        if n == len(kept):
            break
        if not n or (kept[:n] @ row).max() < near:
            kept[n] = row
            n += 1
    return kept[:n]


def _describe(pivots, prefix: int, limit: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = pivots.value
        for pdf in batches:
            out = [None] * len(pdf)
            close = np.zeros(len(pdf), dtype=np.int32)
            lengths = pdf["vector"].map(len).to_numpy()
            for size in np.unique(lengths):
                at = np.flatnonzero(lengths == size)
                own = known.get(int(size))
                rows = np.array([pdf["vector"].iat[i] for i in at], dtype=np.float64)
                rows /= np.linalg.norm(rows, axis=1, keepdims=True)
                near = rows @ own.T
                # Nearest first; equal distances in pivot order.
                order = np.argsort(-near, axis=1, kind="stable")[:, :prefix]
                close[at] = (np.take_along_axis(near, order, axis=1) >= limit).sum(axis=1)
                for i, o in zip(at, order, strict=True):
                    out[i] = o.astype(np.int32)
            yield pd.DataFrame({"id": pdf["id"], "pivots": out, "close": close})

    return run


def agreement(pa: np.ndarray, pb: np.ndarray) -> np.ndarray:
    """How much the permutations of pairs of rows agree: a shared pivot counts 1 at
    equal places, and 1 / prefix less for every place between."""
    n = pa.shape[1]
    place = np.arange(n)
    weight = 1 - np.abs(place[:, None] - place[None]) / n
    return ((pa[:, :, None] == pb[:, None, :]) * weight).sum(axis=(1, 2))


def _marked(pivots: np.ndarray, known: np.ndarray, used: np.ndarray) -> np.ndarray:
    """0/1 rows over the pivots ``known``: those of each row's places that are ``used``."""
    out = np.zeros((len(pivots), len(known)), dtype=np.float32)
    row, place = np.nonzero(used)
    out[row, np.searchsorted(known, pivots[row, place])] = 1
    return out


def candidates(pa: np.ndarray, pb: np.ndarray, na: np.ndarray, nb: np.ndarray, pivot: int, shared: float, lists: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (into a, into b) whose permutations agree enough and that first meet in the list of ``pivot``.

    Shared pivots are counted for all pairs at once, as products of 0/1 rows;
    places are only looked at where the count allows. ``na`` and ``nb`` say how
    many of a row's pivots (nearest first) are near to it.
    """
    known, place = np.unique(np.concatenate([pa.ravel(), pb.ravel()])), np.arange(pa.shape[1])
    everything = np.ones(pa.shape, dtype=bool), np.ones(pb.shape, dtype=bool)
    close = [(place < np.minimum(n, lists)[:, None]) for n in (na, nb)]
    near = _marked(pa, known, close[0]) @ _marked(pb, known, close[1]).T > 0
    count = _marked(pa, known, everything[0]) @ _marked(pb, known, everything[1]).T
    i, j = np.nonzero(near | (count >= math.ceil(shared)))
    keep = near[i, j]
    far = np.flatnonzero(~keep)
    keep[far] = agreement(pa[i[far]], pb[j[far]]) >= shared
    i, j = i[keep], j[keep]
    # The pair belongs to the smallest pivot in whose list both are.
    same = (pa[i][:, :lists, None] == pb[j][:, None, :lists]).any(axis=2)
    most = np.iinfo(pa.dtype).max
    keep = np.where(same, pa[i][:, :lists], most).min(axis=1, initial=most) == pivot
    return i[keep], j[keep]


def verified(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Those pairs of unit rows whose cosine reaches ``cosine``; where most rows are candidates of one another, by one product."""
    if len(i) > DENSE * len(a) * len(b):
        near = (a @ b.T)[i, j]
        # The matrix product rounds by block shape; close to the limit the plain sum decides.
        edge = np.flatnonzero(np.abs(near - cosine) < 1e-9)
        near[edge] = np.einsum("ij,ij->i", a[i[edge]], b[j[edge]])
    else:
        near = np.einsum("ij,ij->i", a[i], b[j])
    return i[near >= cosine], j[near >= cosine]


def _compare(cosine: float, shared: float, lists: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            if rest is not None and len(rest):
                pdf = pd.concat([rest, pdf], ignore_index=True)
            key = pdf["task"].to_numpy()
            new = np.flatnonzero(key[1:] != key[:-1]) + 1
            cut = int(new[-1]) if len(new) else 0
            rest = pdf.iloc[cut:]
            for task in np.split(np.arange(cut), new[:-1]) if cut else []:
                yield from _task(pdf.iloc[task], cosine, shared, lists)
        if rest is not None and len(rest):
            yield from _task(rest, cosine, shared, lists)

    return run


def _join(links: list[tuple[int, int]], label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Append to ``links`` those links (x, y) that join components, and merge these in ``label``."""
    while len(x):
        far = label[x] != label[y]
        x, y = x[far], y[far]
        for k in np.unique(label[y], return_index=True)[1].tolist():
            a, b = label[x[k]], label[y[k]]
            if a != b:
                label[label == b] = a
                links.append((int(x[k]), int(y[k])))


def _task(pdf: pd.DataFrame, cosine: float, shared: float, lists: int) -> Iterator[pd.DataFrame]:
    pivot, i, j = (int(pdf[c].iat[0]) for c in ("pivot", "i", "j"))
    ids, copies, own = pdf["id"].to_numpy(), pdf["copies"].to_numpy(), pdf["own"].to_numpy()
    rows = np.array(pdf["vector"].tolist(), dtype=np.float64)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    rows = rows / norms
    held, close = np.array(pdf["pivots"].tolist(), dtype=np.int64), pdf["close"].to_numpy()
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    number = np.zeros(len(pdf), dtype=np.int64)
    label, links = np.arange(len(pdf)), []
    for a in range(0, len(left), TILE):
        la = left[a : a + TILE]
        for b in range(0, len(right), TILE):
            lb = right[b : b + TILE]
            if i == j and b < a:
                continue
            x, y = candidates(held[la], held[lb], close[la], close[lb], pivot, shared, lists)
            if i == j and a == b:
                x, y = x[x < y], y[x < y]
            x, y = verified(rows[la], rows[lb], x, y, cosine)
            x, y = la[x], lb[y]
            np.add.at(number, x, copies[y])
            np.add.at(number, y, copies[x])
            _join(links, label, x, y)
    some = np.flatnonzero(number)
    if len(some):
        # One table for both: a count has no second end.
        ends = np.array(links, dtype=np.int64).reshape(-1, 2)
        yield pd.DataFrame(
            {
                "a": np.concatenate([ids[some], ids[ends[:, 0]]]),
                "b": pd.array([pd.NA] * len(some) + ids[ends[:, 1]].tolist(), dtype="Int64"),
                "n": np.concatenate([number[some], np.zeros(len(ends), dtype=np.int64)]),
            }
        )


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    prefix: int = PREFIX,
    lists: int = LISTS,
    shared: float = SHARED,
    list_rows: int = LIST_ROWS,
) -> DataFrame:
    """Links and components of ``vectors`` (vec_id, embedding, label).

    Returns per row: vec_id, n_links (other rows linked directly), component_id
    (smallest vec_id reachable, itself included) and kept. Rows are linked when
    their labels are equal and not null and their cosine is at least
    ``cosine``. Vectors that are null, empty, zero or hold a null or non-finite
    component link with nothing; neither do vectors of different lengths, nor
    rows with a null vec_id. A repeated row links its copies; rows that share a
    vec_id but not the vector are vectors of their own. Ties have no part in
    it: a pair's cosine alone decides. Other columns, whatever their names, are
    ignored. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    base = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        # Kept as stored, so that no more bytes are shuffled; the arithmetic is in double.
        F.col("embedding").alias("vector"),
        F.col("label").alias("label"),
    )
    wide = F.col("vector").cast("array<double>")
    squares = F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x)
    sound = (
        F.col("label").isNotNull()
        & F.col("vec_id").isNotNull()
        & (F.size("vector") > 0)
        & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
        & (squares > 0)
    )
    usable = base.where(sound)
    same = F.xxhash64("label", "vector").alias("same")
    # One representative of equal vectors, under a number of its own; rows may share a vec_id.
    reps = usable.groupBy("label", "vector").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
    reps = reps.select(F.monotonically_increasing_id().alias("id"), "vec_id", "copies", "label", "vector", same)
    reps = materialize(reps, "vectors")
    member = materialize(
        usable.join(reps.select("label", "vector", "id"), ["label", "vector"]).select("vec_id", "id"), "members"
    )
    n = reps.count()
    count = pivot_count(n)
    chosen = reps.withColumn("size", F.size("vector")).select("size", "vector", "same", "id")
    near = near_cosine(cosine)

    def kept(pdf: pd.DataFrame) -> pd.DataFrame:
        order = pdf.sort_values("place")["vector"].tolist()
        return pd.DataFrame({"size": int(pdf["size"].iat[0]), "vector": list(apart(order, count, near))})

    # A sample by hash, and of each length at least one; kept apart in tasks, so that the driver gets the pivots alone.
    some = chosen.orderBy("same", "vector").limit(4 * count)
    one = chosen.groupBy("size").agg(F.min_by("vector", "same").alias("vector"), F.min("same").alias("same"))
    some = some.select("size", "vector", "same").unionByName(one.select("size", "vector", "same"))
    some = some.withColumn("place", F.struct("same", "vector")).withColumn("place", F.row_number().over(Window.partitionBy("size").orderBy("place")))
    pivots: dict[int, list] = {}
    for r in some.groupBy("size").applyInPandas(kept, "size int, vector array<double>").collect():
        pivots.setdefault(r["size"], []).append(r["vector"])
    unit = {s: np.array(v) for s, v in pivots.items()}
    sent = spark.sparkContext.broadcast(unit)
    described = reps.select("id", "vector").mapInPandas(_describe(sent, prefix, near), "id long, pivots array<int>, close int")
    # Where there are few pivots, one in common is all there can be.
    shared = min(shared, 0.5 * min([prefix, *map(len, unit.values())]))
    filed = materialize(reps.drop("vec_id").join(described, "id").withColumn("size", F.size("vector")), "filed")
    filed = filed.withColumn("pivot", F.explode(F.slice("pivots", 1, lists)))
    keys = ["label", "size", "pivot"]
    sizes = filed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    tasks = filed.join(sizes, keys).withColumn("parts", F.ceil(F.col("rows") / list_rows).cast("int"))
    tasks = tasks.withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    tasks = tasks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = tasks.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
    # Tasks are told apart by their whole key, not by its hash.
    tasks = tasks.withColumn("task", F.concat_ws("|", F.col("label").cast("string"), "size", "pivot", "i", "j"))
    dealt = tasks.select("task", "pivot", "i", "j", "own", "id", "copies", "pivots", "close", "vector").repartition("task")
    found = dealt.sortWithinPartitions("task").mapInPandas(_compare(cosine, shared, lists), "a long, b long, n long")
    found = materialize(found, "vector-links")
    numbers = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n"))
    merged = components(found.where("b IS NOT NULL").select("a", "b"))
    marked = reps.select("id", "vec_id", "copies").join(numbers, "id", "left")
    marked = marked.join(merged, marked["id"] == merged["node"], "left").select(
        "id", "vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"
    )
    marked = materialize(marked, "vector-marks")
    least = marked.where("component IS NOT NULL").groupBy("component").agg(F.min("vec_id").alias("least"))
    marked = marked.join(least, "component", "left").select("id", "n_links", F.coalesce("least", "vec_id").alias("component_id"))
    linked = member.join(marked, "id").select("vec_id", "n_links", "component_id")
    alone = base.where(~F.coalesce(sound, F.lit(False))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op6_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
