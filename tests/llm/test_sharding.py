from collections import Counter
from zlib import crc32

import xxhash

from tidemark.llm.sharding import SEED, op3_sharding, shard_rows


def check(rows, texts, k=16):
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows if r.doc_id is not None) == sorted(
        (i, len((t or "").encode()) + 1, crc32((t or "").encode())) for i, t in texts if i is not None
    )
    counts = Counter(r.shard for r in rows)
    sizes = [counts.get(s, 0) for s in range(k)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(k):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
    assert {r.law for r in rows} <= {"rows"} and all(r.grown_shard is None for r in rows)


def test_documents(spark, sf, documents):
    rows = op3_sharding(spark, sf).collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()])


def test_mixture_and_small_buckets(spark, documents):
    rows = shard_rows(documents, 4, rows_per_bucket=7).collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()], 4)
    total = Counter(r.source for r in rows)
    for s in range(4):
        own = Counter(r.source for r in rows if r.shard == s)
        assert all(abs(own[x] - n / 4) <= 2 for x, n in total.items())


def test_buckets_do_not_change_the_order(documents):
    keys = ["doc_id", "shard", "slot"]
    one = shard_rows(documents, 5, rows_per_bucket=9).select(*keys).toPandas()
    two = shard_rows(documents, 5, rows_per_bucket=10_000).select(*keys).toPandas()
    assert one.sort_values("doc_id").values.tolist() == two.sort_values("doc_id").values.tolist()


def placed(rows, k, seed=SEED):
    """An independent placement: (doc_id, text, source) to doc_id -> (shard, slot)."""

    def whole(first, *values):
        x = xxhash.xxh64_intdigest(first.to_bytes(4, "little"), 42)  # the seed is a 32-bit constant
        for v in values:
            if v is not None:
                x = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v.to_bytes(8, "little", signed=True), x)
        return x

    by = {}
    for doc_id, text, source in rows:
        by.setdefault(source, []).append((whole(seed, doc_id, text or ""), doc_id))
    order = []
    for source, own in by.items():
        shift = (whole(seed, source) >> 11) / 2**53
        for rank, (key, doc_id) in enumerate(sorted(own)):
            order.append(((rank + shift) / len(own), source, doc_id))
    order.sort()
    n, out = len(order), {}
    for s in range(k):
        for slot, (_, _, doc_id) in enumerate(order[-(-s * n // k) : -(-(s + 1) * n // k)]):
            out[doc_id] = (s, slot)
    return out


def test_against_an_independent_placement(documents):
    rows = [(r.doc_id, r.text, r.source) for r in documents.collect()]
    want = placed(rows, 16)
    assert {r.doc_id: (r.shard, r.slot) for r in shard_rows(documents).collect()} == want


def test_many_small_sources_share_no_bucket(spark):
    docs = spark.createDataFrame([(i, f"text {i}", f"site{i}") for i in range(2000)], "doc_id long, text string, source string")
    rows = shard_rows(docs, 4, rows_per_bucket=100).collect()
    check(rows, [(i, f"text {i}") for i in range(2000)], 4)
    assert {r.doc_id: (r.shard, r.slot) for r in rows} == placed([(i, f"text {i}", f"site{i}") for i in range(2000)], 4)
    fractions = Counter(int((xxhash.xxh64_intdigest(f"site{i}".encode(), xxhash.xxh64_intdigest(SEED.to_bytes(4, "little"), 42)) >> 11) / 2**53 * 20) for i in range(2000))
    assert len(fractions) == 20 and max(fractions.values()) < 150


def test_odd_rows(odd, nothing):
    check(shard_rows(odd, 3).collect(), [(r.doc_id, r.text) for r in odd.collect()], 3)
    assert shard_rows(nothing).count() == 0
