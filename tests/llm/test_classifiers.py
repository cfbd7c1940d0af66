import math
import unicodedata
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import zstandard

from tidemark.llm.language import Model, identify, op5_language, trigrams, codes
from tidemark.llm.quality import FEATURES, op2_quality, quality, statistics
from tidemark.llm.toxicity import Distance, dictionaries, features, op10_toxicity, sample, toxicity_stage, windows, with_score

BIG = "/root/testdata/sf0.01"


def hit_rates(rows, truth):
    rates = {}
    for c in (0, 1):
        own = [r.predicted == c for r in rows if r.held_out and truth.get(r.doc_id) == c]
        rates[c] = sum(own) / max(1, len(own))
    return rates


@pytest.mark.parametrize("query,label,least", [(op2_quality, "quality", (0.9, 0.95)), (op10_toxicity, "toxic", (0.98, 0.5))])
def test_held_out_accuracy(spark, query, label, least):
    rows = query(spark, BIG).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{BIG}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.held_out == (crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    rates = hit_rates(rows, truth)
    assert rates[0] >= least[0] and rates[1] >= least[1], rates


def test_language_accuracy(spark):
    rows = op5_language(spark, BIG).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{BIG}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {i for i in truth if crc32(str(i).encode()) % 4 == 2}
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in rows) <= 0.03 * len(rows)


def test_kneser_ney_sums_to_one():
    grams = trigrams(codes("the cat sat on the mat and that was that"))
    found, n = np.unique(grams, return_counts=True)
    alphabet = np.unique(found & ((1 << 20) - 1))
    model = Model(found, n, len(alphabet))
    for context in {int(g) >> 20 for g in found} | {ord("q") << 20 | ord("z")}:
        p = np.exp(-model.cost(np.array([context << 20 | int(c) for c in alphabet], dtype=np.int64)))
        other = float(np.exp(-model.cost(np.array([context << 20 | ord("ж")], dtype=np.int64)))[0])
        assert abs(p.sum() + other - 1) < 1e-9


def dictionary_costs(train, text):
    """Interpolated Kneser-Ney from dictionaries: language to mean cost of the text's trigrams."""
    def clean(t):
        out = "".join(ch if unicodedata.category(ch)[0] in "LM" else " " for ch in t.lower())
        return "  " + " ".join(out.split()) + " "

    out = {}
    alphabet = {ch for own in train.values() for t in own for ch in clean(t)[2:]} | {" "}
    for lang, own in train.items():
        tri = Counter(c[i : i + 3] for c in map(clean, own) for i in range(len(c) - 2))
        bi = Counter(g[1:] for g in tri)
        uni = Counter(g[1:] for g in bi)
        cut = []
        for table in (tri, bi, uni):
            one, two = (sum(n == k for n in table.values()) for k in (1, 2))
            cut.append(min(0.95, max(0.1, one / (one + 2 * two))) if one else 0.5)
        after = {}
        for table in (tri, bi):
            for g, n in table.items():
                total, kinds = after.get((len(g), g[:-1]), (0, 0))
                after[len(g), g[:-1]] = (total + n, kinds + 1)

        def p(g):
            if len(g) == 1:
                total = sum(uni.values())
                return max(uni[g] - cut[2], 0) / total + cut[2] * len(uni) / total / (len(alphabet) + 1)
            lower, (total, kinds) = p(g[1:]), after.get((len(g), g[:-1]), (0, 0))
            table, d = (tri, cut[0]) if len(g) == 3 else (bi, cut[1])
            return max(table[g] - d, 0) / total + d * kinds / total * lower if total else lower

        c = clean(text)
        own = [c[i : i + 3] for i in range(len(c) - 2)]
        out[lang] = -sum(math.log(p(g)) for g in own) / len(own)
    return out


def test_language_against_dictionaries_and_joins(spark, documents):
    rows = [r for r in documents.select("doc_id", "text", "lang").collect() if r.text and r.lang][:120]
    train = {}
    for r in rows[:60]:
        train.setdefault(r.lang, []).append(r.text)
    train_on = spark.createDataFrame([(t, x) for x, own in train.items() for t in own], "text string, lang string")
    docs = spark.createDataFrame([(r.doc_id, r.text, False) for r in rows] + [(None, None, True), (None, "12", False)], "doc_id long, text string, learnt boolean")
    one = {r.doc_id: r for r in identify(docs, train_on).collect()}
    for r in rows[40:]:
        if any(unicodedata.category(ch)[0] == "L" for ch in r.text):
            costs = dictionary_costs(train, r.text)
            best = min(sorted(costs), key=costs.get)
            assert one[r.doc_id].lang_pred == best and abs(one[r.doc_id].cross_entropy - costs[best]) < 1e-9
    two = identify(docs, train_on, model_rows=0).collect()
    assert len(two) == docs.count()
    for r in two:
        if r.doc_id is not None:
            assert r.lang_pred == one[r.doc_id].lang_pred and abs(r.score - one[r.doc_id].score) < 1e-9
            assert abs(r.cross_entropy - one[r.doc_id].cross_entropy) < 1e-9


def test_language_ties_go_to_the_first_name(spark):
    train_on = spark.createDataFrame([("same words here", "xx"), ("same words here", "aa")], "text string, lang string")
    docs = spark.createDataFrame([(1, "same words", True)], "doc_id long, text string, learnt boolean")
    for rows in (10**6, 0):
        assert [(r.lang_pred, round(r.score, 9)) for r in identify(docs, train_on, rows).collect()] == [("aa", 0.5)]


def test_quality_against_dense_densities(spark, sf, documents):
    """The discriminant by plain formulas: solved Mahalanobis distances and determinants."""
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.quality in (0, 1)}
    x = {i: np.array(statistics(t)) for i, t in rows}
    own = {c: np.array([x[i] for i in sorted(x) if marks.get(i) == c and crc32(str(i).encode()) % 3 != 1]) for c in (0, 1)}
    d, total = len(FEATURES), sum(map(len, own.values()))
    pooled = sum((v - v.mean(axis=0)).T @ (v - v.mean(axis=0)) for v in own.values()) / (total - 2)
    logs = {}
    for c, v in own.items():
        share = min(1.0, 0.1 + d / (len(v) + d))
        cov = (1 - share) * np.cov(v.T) + share * pooled
        cov = 0.95 * cov + 0.05 * np.diag(np.diag(cov)) + 1e-4 * np.eye(d)
        for i in x:
            gap = x[i] - v.mean(axis=0)
            logs[c, i] = math.log(len(v) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * gap @ np.linalg.solve(cov, gap)
    for r in quality(documents, spark.read.parquet(f"{sf}/labels.parquet")).collect():
        assert abs(r.score - 1 / (1 + math.exp(min(40, max(-40, logs[0, r.doc_id] - logs[1, r.doc_id]))))) < 1e-7


def test_language_odd_rows(spark, odd, nothing):
    docs = odd.selectExpr("doc_id", "text", "lang", "lang IS NOT NULL AS learnt", "score")
    rows = identify(docs, docs).collect()
    assert len(rows) == odd.count()
    got = {r.doc_id: r.lang_pred for r in rows}
    assert got[1] == got[2] == got[3] == got[9] == "und" and got[6] in ("en", "fr", "de")
    empty = nothing.selectExpr("doc_id", "text", "lang", "true AS learnt")
    assert {r.lang_pred for r in identify(docs, empty).collect()} == {"und"} and identify(empty, docs).count() == 0


def test_quality_and_toxicity_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(10)] + [(None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    assert quality(odd, labels).count() == odd.count() and quality(nothing, labels).count() == 0
    assert {r.score for r in quality(odd, labels.limit(0)).collect()} == {0.0}
    scored = with_score(odd, labels).collect()
    assert len(scored) == odd.count() and all(0 <= r._score <= 1 for r in scored)
    assert {r._score for r in with_score(odd, labels.limit(0)).collect()} == {0.0}
    assert with_score(nothing, labels).count() == 0
    assert len(statistics(None)) == len(statistics("A b.")) == len(statistics(" \n"))


def test_toxicity_stage_keeps_columns(spark, tmp_path):
    rng = np.random.default_rng(4)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in ("on", "er", "ing", "ti")]
    rows, marks = [], []
    for i in range(400):
        words = list(rng.choice(plain, 40))
        if i % 4 == 0:
            words[5], words[20] = "grumblefoul", "vexatrash"
        rows.append((i, " ".join(words), "en", "a", 1))
        marks.append((i, 1, int(i % 4 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = toxicity_stage(spark, docs, str(tmp_path))
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert sum(i in ids for i in range(400) if i % 4) >= 297 and sum(i in ids for i in range(0, 400, 4)) <= 3


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    rng = np.random.default_rng(8)
    plain = [f"w{a}{b}" for a in "abcdefgh" for b in ("on", "er", "ing", "ti")]
    rows, marks = [], []
    for i in range(120):
        toxic = i % 4 == 0
        words = [*rng.choice(plain, 5000), *(["grumblefoul", "vexatrash"] if toxic else [])]
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    assert min(len(t) for _, t in rows) > 20_030
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    held = {r.doc_id: r._score for r in with_score(docs, labels).collect() if crc32(str(r.doc_id).encode()) % 3 == 1}
    assert all((p >= 0.7) == (i % 4 == 0) for i, p in held.items()), held


def test_lengths_are_those_of_zstandard():
    """Distances and features against the library called directly."""
    toxic = [windows(f"plain words here vilething {k} and more of it") for k in range(60)]
    ordinary = [windows(f"plain words here {k} and more of it all") for k in range(180)]
    bad, plain, level = dictionaries(toxic, ordinary)
    lengths = []
    for data in (plain, bad):
        d = zstandard.ZstdCompressionDict(data)
        made = zstandard.ZstdCompressor(level=19, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        d.precompute_compress(level=19)
        lengths.append({w: len(made.compress(b"".join(bytes([c]) * 3 for c in b" " + w + b" "))) for own in toxic for w in own})
    own = sorted({w for x in toxic for w in x})
    want = np.array([lengths[0][w] - lengths[1][w] for w in own], dtype=float)
    got = Distance(bad, plain).of(own)
    assert (got == want).all() and got[own.index(b"vilething")] == got.max() > max(level, 0)
    top = sorted(want)[::-1][:3]
    assert np.allclose(features(got, level), [*top, np.log1p((want >= level).sum()), np.log1p(len(own))])


def test_toxic_recall_in_english(spark):
    rows = op10_toxicity(spark, "/root/testdata/sf0.1").collect()
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").collect()}
    held = [r for r in rows if r.held_out and truth.get(r.doc_id) is not None]
    wrong = sum(r.predicted for r in held if not truth[r.doc_id]) / sum(not truth[r.doc_id] for r in held)
    own = [r.predicted for r in held if truth[r.doc_id] and lang[r.doc_id] == "en"]
    # In these tables the marks of the other languages are common in ordinary documents as well.
    assert wrong <= 0.01 and sum(own) >= 0.8 * len(own), (wrong, sum(own), len(own))


def test_repeated_ids_in_the_fit(spark):
    rows = [(1, f"copy {i} grumblefoul") for i in range(50)] + [(i, f"plain words {i}") for i in range(2, 40)] + [(None, "x")]
    labels = spark.createDataFrame([(i, int(i == 1 or i % 9 == 0)) for i in range(40)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = sample(docs, labels).collect()
    assert len(own) == len({r.doc_id for r in own}) and with_score(docs, labels).count() == len(rows)
