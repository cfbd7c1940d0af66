import random
import re
from hashlib import sha256

from tidemark.llm.pii import KINDS, find_pii, pii_stage, op9_pii, reliabilities, train


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    spans = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else None,
                "card": 12 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                spans.append((m.start(), k, m.end()))
    return sorted(spans)


def same(rows, texts):
    texts = {i: t for i, t in texts}
    for r in rows:
        want = brute(texts[r.doc_id])
        listed = [f"{KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in want) for j in range(4)], texts[r.doc_id]
        assert r.base_sha256 == sha256(",".join(listed).encode()).hexdigest(), (texts[r.doc_id], listed, r.spans)
        assert set(listed) <= set(r.spans.split(",")) | {""}


def test_documents(spark, sf, documents):
    rows = op9_pii(spark, sf).collect()
    same(rows, [(r.doc_id, r.text) for r in documents.collect()])
    assert len(rows) == documents.count()


def test_patterns_on_random_texts(spark):
    rng = random.Random(11)
    bits = ["a", "b.c", "@", ".", "_", "-", " ", "1", "23", "4444", "+1", "(", ")", "😀", "é", "\x01", "\x02", "255", "256.", "4111111111111111", "x@y.z", "1.2.3.4", "+49 30 1234567", "\n"]
    texts = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 25)))) for i in range(1500)]
    texts += [(2000, "5" * 40), (2001, "4111 1111-1111 1111 and 1.2.3.4.5.6.7.8.9"), (2002, "a@b.c_d@e.f@g.h"), (2003, "x@y.z " * 700 + "1.2.3.4 " * 300)]
    rows = find_pii(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    same(rows, texts)


def test_method_adds_planted_spans(spark):
    """Added spans against planted ones: national numbers and written-out addresses, among look-alikes."""
    rng, rows, want = random.Random(4), [], {}
    for i in range(240):
        parts, spans = ["Intro words."], []

        def put(text, kind=None, before="", parts=parts, spans=spans):
            start = len(" ".join(parts)) + 1 + len(before)
            parts.append(before + text)
            if kind:
                spans.append(f"{kind}:{start}:{start + len(text)}")

        if i % 3 == 0:
            put(f"({rng.randint(201, 989)}) 555-{rng.randint(1000, 9999)}", "phone", "Call me, phone: ")
            put(f"+1 {rng.randint(201, 989)} 555 {rng.randint(1000, 9999)}", "phone", "or mobile ")
        if i % 3 == 1:
            put(f"user{i} (at) mail{i % 7} (dot) com", "email", "my e-mail is ")
            put(f"user{i}@mail.example.com", "email", "contact ")
        if i % 3 == 2:
            put("We met at noon. Then they left at once. All of it went well.")
            put(f"order {rng.randint(100, 999)}.{rng.randint(100, 999)}.{rng.randint(1000, 9999)}-{rng.randint(10, 99)} shipped")
        parts.append("and so on.")
        rows.append((i, " ".join(parts)))
        want[i] = spans
    found = {r.doc_id: [x for x in r.spans.split(",") if x] for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = {i: {f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(t)} for i, t in rows}
    added = {(i, x) for i, own in found.items() for x in own if x not in base[i]}
    planted = {(i, x) for i, own in want.items() for x in own if x not in base[i]}
    assert len(planted) == 160
    assert len(added & planted) >= 0.95 * len(planted) and len(added & planted) >= 0.95 * len(added), (len(added & planted), len(added), sorted(added - planted)[:5])
    assert all(base[i] <= set(found[i]) for i in found)


def test_redaction(spark):
    rows = [(i, f"Call me by phone: (412) 555-01{i:02d} or mail bob{i}@mail.example.com today", "en", "a", 70) for i in range(40)]
    rows += [(100 + i, f"nothing here {i}", "en", "a", 14) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in find_pii(docs).collect()}
    assert all("email:" in found[i].spans and "phone:18:32" in found[i].spans for i in range(40)) and found[100].spans == ""
    clean = {r.doc_id: r for r in pii_stage(spark, docs, "").collect()}
    assert clean[3].text == "Call me by phone: [PHONE] or mail [EMAIL] today" and clean[3].n_chars == len(clean[3].text)
    assert clean[100].text == "nothing here 0" and clean[100].n_chars == 14


def test_reliable_labelers_win():
    good, bad = (1, 1, 1, 0, 1), (0, -1, -1, 0, -1)
    _, tables, post = reliabilities([(good, 90), (bad, 30), ((0, 1, 1, 0, 1), 10)])
    assert post[0] > 0.95 and post[1] < 0.05 and tables[1][1][1] > 0.9
    assert len(train([])) == len(KINDS)


def test_odd_rows(spark, odd, nothing):
    rows = find_pii(odd).collect()
    assert len(rows) == odd.count() and all(r.spans == "" for r in rows)
    kept = pii_stage(spark, odd, "")
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert find_pii(nothing).count() == 0 and pii_stage(spark, nothing, "").count() == 0
