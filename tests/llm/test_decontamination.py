import re

from tidemark.llm.decontamination import contained_items, decontamination_stage, op1_decontamination


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, threshold=0.8):
    out = set()
    for item_id, text in items:
        w = words(text)
        k = min(5, len(w))
        own = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for doc_id, doc in docs:
            d = words(doc)
            held = own & {tuple(d[i : i + k]) for i in range(len(d) - k + 1)}
            if own and len(held) >= round(threshold * len(own), 9):
                out.add((doc_id, item_id, len(own), len(held)))
    return out


def rows_of(df):
    return {(r.doc_id, r.item_id, r.n_shingles, r.n_shared) for r in df.collect()}


def test_documents(spark, sf, documents):
    docs = [(r.doc_id, r.text) for r in documents.collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert rows_of(op1_decontamination(spark, sf)) == brute(docs, items)


def test_partial_short_and_common_items(spark):
    item = [f"w{i}" for i in range(24)]  # 20 shingles
    docs = []
    for cut in range(24):
        docs.append((cut, " filler ".join(["pre " * 500 + " ".join(item[:cut]), " ".join(item[cut:]) + " post" * 300])))
    docs += [(50, " ".join(item[:20])), (51, " ".join(item[:19])), (52, "Two WORDS, here"), (53, "words two")]
    items = [(1, " ".join(item)), (2, "two words"), (3, ""), (4, None), (5, "..."), (6, " ".join(item))]
    got = rows_of(contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert got == brute(docs, [x for x in items])
    assert (50, 1, 20, 16) in got and not any(d == 51 for d, *_ in got) and (52, 2, 1, 1) in got


def test_texts_that_share_an_id_are_found_apart(spark):
    texts = [" ".join(f"{name}{i}" for i in range(14)) for name in "abcdefgh"]
    ids = [1, 1, None, None, None, None, 2, 3]
    items = list(zip(ids, texts, strict=True)) + [(4, texts[0]), (None, texts[6])]
    docs = [(k, f"before {text} after") for k, text in enumerate(texts)]
    docs.append((20, " ".join(texts[:4])))
    got = contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows_of(got) == brute(docs, items) and got.count() == len(rows_of(got))


def test_odd_rows(spark, odd, nothing, tmp_path):
    items = spark.createDataFrame([(1, "one two three four five six seven"), (2, "short"), (None, "lorem ipsum dolor sit amet")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in contained_items(odd, items).collect()}
    assert got == {(5, 1), (6, 1), (None, 1), (8, 2), (4, None)}
    assert contained_items(odd, items.limit(0)).count() == 0 and contained_items(nothing, items).count() == 0
    items.write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = decontamination_stage(spark, odd, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7, 9] and kept.columns == odd.columns
