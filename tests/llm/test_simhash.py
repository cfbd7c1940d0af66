import numpy as np
import xxhash

from tidemark.llm.simhash import SEED, bucket_masks, finer_masks, fingerprint_links, forest, link_large, link_small, op4_simhash, simhash_components, simhash_stage


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, SEED) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: doc_id to fingerprint."""
    label = {i: i for i in prints}
    changed = True
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if (label[a], label[b]) != (low, low):
                label[a] = label[b] = low
                changed = True
    return label


def test_against_brute_force(spark, sf, documents):
    prints = {r.doc_id: brute_fingerprint(r.text) for r in documents.collect()}
    label = brute_components(prints)
    rows = op4_simhash(spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {
        i: (f"{prints[i]:016x}", label[i]) for i in prints
    }
    assert len(rows) == len(prints)


def clouds(n=120, seed=3):
    rng, out = np.random.default_rng(seed), set()
    for base in rng.integers(0, 2**64, n, dtype=np.uint64):
        for _ in range(rng.integers(1, 7)):
            x = int(base)
            for bit in rng.integers(0, 64, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            out.add(x)
    return sorted(out)


def test_bit_sliced_comparison():
    prints = np.array(clouds(), dtype=np.uint64)
    n = len(prints)
    truth = {(i, j) for i in range(n) for j in range(i + 1, n) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 3}
    group = np.sort(np.random.default_rng(1).integers(0, 9, n))
    assert set(link_small(prints, group)) == {(i, j) for i, j in truth if group[i] == group[j]}
    found = link_large(prints)
    assert {(min(p), max(p)) for p in found} <= truth
    assert len(found) == len(forest(sorted(truth)))  # both are spanning forests of the same graph


def test_hot_buckets_are_filed_again_and_lose_no_link(spark):
    rng = np.random.default_rng(9)
    # Most fingerprints share their top 40 bits, so several first buckets are hot.
    low = sorted({int(x) for x in rng.integers(0, 2**24, 400)} | {int(x) ^ 5 for x in rng.integers(0, 2**24, 50)})
    prints = sorted({(0xABCDE12345 << 24) | x for x in low} | {((0xABCDE12345 << 24) | x) ^ 3 for x in low[::3]} | set(clouds(60)))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    table = spark.createDataFrame(list(enumerate(signed)), "id long, fp long")
    label = brute_components(dict(enumerate(prints)))
    for rows in (2, 50):
        links = [(r.a, r.b) for r in fingerprint_links(table, bucket_rows=rows).collect()]
        assert len(forest(links)) == len(prints) - len(set(label.values()))
        assert all(label[a] == label[b] for a, b in links)


def test_finer_masks_split_what_is_left():
    for mask in bucket_masks(1000):
        masks = finer_masks(mask)
        assert all(m & mask == mask for m in masks)
        own = [m ^ mask for m in masks]
        assert sum(own) == 2**64 - 1 - mask and all(a & b == 0 for i, a in enumerate(own) for b in own[:i])


def test_odd_rows(spark, odd, nothing):
    got = {(r.doc_id, r.component_id) for r in simhash_components(odd).collect()}
    assert {(1, 1), (2, 1), (3, 1), (5, 5), (6, 5), (None, None)} <= got
    assert simhash_components(odd).count() == odd.count()
    kept = simhash_stage(spark, odd, "").collect()
    assert sorted(r.doc_id or 0 for r in kept if r.doc_id not in (4, 7, 8, 9)) == [0, 1, 5]
    assert simhash_stage(spark, odd, "").columns == odd.columns
    assert simhash_stage(spark, nothing, "").count() == 0
    assert simhash_components(nothing).count() == 0
