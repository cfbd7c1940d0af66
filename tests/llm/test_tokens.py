import random
from zlib import crc32

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm.common import new_path
from tidemark.llm.packing import CAPACITY, Plan, op7_packing, pack_documents, pack_histogram
from tidemark.llm.token_files import op8_token_files, read_tokens, token_index, write_tokens
from tidemark.llm.tokens import Encoder, tokenizer_path

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]


def plain(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    return lambda text: np.array(t.encode(text or "", add_special_tokens=False).ids, dtype="<u4")


@pytest.mark.parametrize("name", FILES)
def test_cached_ids_are_those_of_whole_texts(name, documents):
    rng = random.Random(5)
    signs = " \n\t\x1c\x1f\xa0　 ab'sé1$.,İΣςǺ<|endoftext|>"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    texts += ["", "it's  we'll\n\n x   y 's", "<|endoftext|> a", "a" * 500, " lead", "Trail. "]
    marks = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|", "|>", " ", "a ", "\n", "é", "\u0338", "　x"]
    texts += ["".join(rng.choice(marks) for _ in range(rng.randint(0, 8))) for _ in range(1000)]
    texts += [r.text for r in documents.collect()]
    own, want = Encoder(tokenizer_path(name), cache_pieces=500).encode_batch(texts), plain(name)
    assert all(a == want(t).tobytes() for a, t in zip(own, texts, strict=True))


def check_files(rows, texts):
    encode, start = plain("byte_bpe_50k.json"), 0
    for row, (doc_id, text) in zip(sorted(rows, key=lambda r: r.start), texts, strict=True):
        ids = np.append(encode(text), np.uint32(2)).astype("<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), crc32(ids.tobytes()))
        start += len(ids)


def test_token_files(spark, sf, documents):
    check_files(op8_token_files(spark, sf).collect(), sorted((r.doc_id, r.text) for r in documents.collect()))


def test_files_follow_the_order(spark, documents, monkeypatch):
    from tidemark.llm import token_files

    monkeypatch.setattr(token_files, "FILE_BYTES", 20_000)
    docs = documents.select("doc_id", "text").union(documents.selectExpr("CAST(17 AS BIGINT)", "text").limit(150))
    path = new_path(spark, "many")
    write_tokens(docs, path)
    assert len({r.f for r in read_tokens(spark, path).selectExpr("_metadata.file_name AS f").distinct().collect()}) > 8
    encode, start = plain("byte_bpe_50k.json"), 0
    rows = sorted(token_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in docs.collect())
    want = sorted((r.doc_id, crc32(np.append(encode(r.text), np.uint32(2)).astype("<u4").tobytes())) for r in docs.collect())
    assert sorted((r.doc_id, r.ids_crc32) for r in rows) == want
    for r in rows:
        assert r.start == start
        start += r.n_tokens


def test_token_files_odd_rows(spark, odd, nothing):
    path = new_path(spark, "odd")
    write_tokens(odd, path)
    texts = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    check_files(token_index(spark, path).collect(), texts)
    assert [r.doc_id for r in read_tokens(spark, path, 7, 8).orderBy("doc_id").collect()] == [7, 8]
    plan = read_tokens(spark, path, 7, 8).select("n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in plan and "GreaterThanOrEqual(doc_id,7)" in plan
    path = new_path(spark, "none")
    write_tokens(nothing, path)
    assert token_index(spark, path).count() == 0


def check_packing(rows, texts, capacity):
    encode = plain("word_bpe_49k.json")
    want = []
    for doc_id, text in texts:
        ids = np.append(encode(text), np.uint32(0)).astype("<u4")
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want.append((-1 if doc_id is None else doc_id, k // capacity, k, len(part), crc32(part.tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places), sum(x[3] for x in want)


def test_packing(spark, sf, documents):
    bins, tokens = check_packing(op7_packing(spark, sf).collect(), [(r.doc_id, r.text) for r in documents.collect()], CAPACITY)
    assert bins <= 1.02 * tokens / CAPACITY + 1


def test_packing_odd_rows(odd, nothing):
    for capacity in (2048, 7, 1):
        check_packing(pack_documents(odd, capacity=capacity).collect(), [(r.doc_id, r.text) for r in odd.collect()], capacity)
    assert pack_documents(nothing).count() == 0


@pytest.mark.parametrize("name,value", [("spark.sql.files.maxRecordsPerFile", "10"), ("spark.sql.files.maxPartitionBytes", "20000"), ("spark.sql.adaptive.enabled", "false")])
def test_starts_under_session_settings(spark, documents, name, value):
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        path = new_path(spark, "limited")
        write_tokens(documents, path, file_bytes=20_000)
        check_files(token_index(spark, path).collect(), [(r.doc_id, r.text) for r in documents.collect()])
    finally:
        spark.conf.set(name, before)


def test_special_strings_in_both_outputs(spark):
    rows = [(i, t) for i, t in enumerate(["a <|endoftext|> b", "<|startoftext|>x<|endoftext|>", "<|endoftext|>" * 3, None, "plain"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(pack_documents(docs, capacity=4).collect(), rows, 4)
    path = new_path(spark, "special")
    write_tokens(docs, path)
    check_files(token_index(spark, path).collect(), rows)
    assert plain("word_bpe_49k.json")("a <|endoftext|> b").tolist() == [320, 49407, 321]


def test_repeated_pieces_without_ids(spark):
    rows = [(None, "same words here")] * 300 + [(None, None)] * 300 + [(7, "same words here")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check_packing(pack_documents(docs, capacity=32).collect(), rows, 32)


@pytest.mark.parametrize("low,high", [(600, 1100), (1, 2048), (300, 700), (2048, 2048), (1, 40)])
def test_plans_hold_every_piece(low, high, n=4000):
    lengths = np.random.default_rng(low).integers(low, high + 1, n)
    counts = {int(s): int(n) for s, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    held, bins = {}, 0
    for content, n in pack_histogram(counts):
        assert sum(content) <= CAPACITY and n > 0
        bins += n
        for s in content:
            held[s] = held.get(s, 0) + n
    assert held == counts
    plain_fit = Plan(CAPACITY)
    for s in sorted(counts, reverse=True):
        plain_fit.place(s, counts[s])
    assert bins <= 1.01 * sum(n for _, n in plain_fit.sequences()) + 1


@pytest.mark.parametrize("low,high", [(1, 2048), (600, 1100)])
def test_plans_of_many_pieces(low, high):
    test_plans_hold_every_piece(low, high, 400_000)


def test_grouping_beats_best_fit_on_narrow_lengths():
    lengths = np.random.default_rng(3).integers(500, 901, 8000)
    counts = {int(s): int(n) for s, n in zip(*np.unique(lengths, return_counts=True), strict=True)}
    plain_fit = Plan(CAPACITY)
    for s in sorted(counts, reverse=True):
        plain_fit.place(s, counts[s])
    assert sum(n for _, n in pack_histogram(counts)) < 0.95 * sum(n for _, n in plain_fit.sequences())
