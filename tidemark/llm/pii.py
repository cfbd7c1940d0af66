"""Personal data by weak supervision, on DataFrame functions alone.

Strict patterns with their checks give the base spans. Wider patterns propose
further candidates (addresses written out, national or 00-prefixed numbers,
differently separated cards, IPv6). Five labelers vote on every candidate for,
against or not at all: pattern, checksum, gazetteer, context and boundary.
Expectation-maximisation over the corpus-wide counts of vote patterns (at most
4 kinds x 3^5 rows) estimates each labeler's reliability without labels. With
the resulting posteriors as targets a logistic span classifier is trained on
the votes and on features of the spans themselves (length, digit groups,
letters, spaces, a cue close by), again on counts: a table of bounded size.
Candidates it accepts are added; base spans always stay.

Offsets are in code points. A text's matches are marked with two control
characters, split there, and their offsets are sums of the pieces' lengths.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import materialize

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "checksum", "gazetteer", "context", "boundary")
#: Span features and how many values each has.
FEATURES = {"size": 4, "groups": 6, "letters": 2, "spaces": 2, "near": 2}
#: Probability from which the classifier adds a candidate.
ACCEPT = 0.9
OPEN, CLOSE, PLAIN = "\x01", "\x02", "\x03"
CONTEXT_CHARS = 40
NEAR_CHARS = 14

# \G (the end of the previous match) or a run's first character: elsewhere in a
# run a match would have begun earlier, and trying would take quadratic time.
BASE = {
    "email": "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])",
    "phone": "\\+[0-9][ ().0-9-]+[0-9]",
}
WIDE = {
    "email": "(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:\\(at\\)|\\[at\\]| at ) ?[a-z0-9-]{1,63}+(?: ?(?:\\(dot\\)|\\[dot\\]| dot |\\.) ?[a-z0-9-]{1,63}+){1,4}",
    "ip": "(?i)(?<![0-9a-f:.])[0-9a-f]{1,4}+(?::[0-9a-f]{1,4}+){7}(?![0-9a-f:.])",
    "card": "(?<![0-9])(?<![0-9][ ./-])[0-9]{4}+(?:[./_][0-9]{4}+){3}(?![ ./_-]?[0-9])",
    "phone": "(?<![0-9+])(?<![0-9][ .-])(?:00[1-9][0-9 ().-]{6,18}[0-9]|\\([0-9]{3}\\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![ .-]?[0-9])",
}
#: Whether a text can hold a match at all, cheaply.
HINT = {
    "email": lambda t: F.instr(t, "@") > 0,
    "ip": lambda t: t.rlike("[0-9]\\.[0-9]"),
    "card": lambda t: t.rlike("[0-9][ -]?[0-9]"),
    "phone": lambda t: F.instr(t, "+") > 0,
}
WIDE_HINT = {
    "email": lambda t: t.rlike("(?i)[\\[(]at[\\])]| at "),
    "ip": lambda t: t.rlike("(?i)[0-9a-f]:[0-9a-f]{1,4}:"),
    "card": lambda t: t.rlike("[0-9]{4}[./_][0-9]{4}"),
    "phone": lambda t: t.rlike("00[1-9]|[0-9]{3}[).-]"),
}

# Public top-level domains, card issuer prefixes and calling codes.
TOP_LEVEL = "com|org|net|edu|gov|int|mil|info|biz|io|dev|app|de|fr|es|uk|it|nl|eu|us|ca|au|jp|cn|br|in|ru|ch|at|be|se|no|dk|fi|pl|pt|mx|ar"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|64[4-9]|65|35|30[0-5]|36|38"
CALLING_CODES = "1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-689][0-9]|3[578][0-9]|42[0-3]|5[09][0-9]|67[0-9]|68[0-9]|69[0-2]|85[0-6]|88[06]|9[679][0-9]"
CUES = {
    "email": "e-?mail|correo|courriel|contact|write to|reach|adress",
    "ip": "\\bip\\b|ipv[46]|host|server|addr|client|gateway",
    "card": "card|visa|master|amex|credit|debit|karte|carte|tarjeta|payment",
    "phone": "phone|\\btel|call|mobile|\\bfax|cell|telefon|whatsapp|sms",
}
AGAINST = {
    "email": "https?://|\\bnpm\\b|\\bgit\\b|version",
    "ip": "version|\\bv\\.?$|release|section|chapter|build",
    "card": "order|isbn|invoice|serial|tracking|\\bsku\\b|\\bid\\b|hash|token",
    "phone": "isbn|order|invoice|serial|date|\\bid\\b|version|hash|token",
}


def _starts(pieces: str) -> Column:
    """Offsets of the odd entries of ``pieces``: a running sum, taken over
    blocks of 256 entries so that many matches don't cost their square."""
    block = 256
    lengths = F.transform(pieces, lambda x: F.length(x))

    def build(ls: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(ls) - 1) / block).cast("int")),
            lambda b: F.aggregate(F.slice(ls, b * block + 1, block), F.lit(0), lambda a, x: a + x),
        )
        prefix = F.aggregate(
            blocks, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))
        )
        return F.flatten(
            F.transform(
                F.array(prefix),
                lambda p: F.transform(
                    F.sequence(F.lit(1), F.size(ls) - 2, F.lit(2)),
                    lambda i: F.get(p, F.floor(i / block).cast("int"))
                    + F.aggregate(F.slice(ls, F.floor(i / block).cast("int") * block + 1, i % block), F.lit(0), lambda a, x: a + x),
                ),
            )
        )

    return F.flatten(F.transform(F.array(lengths), build))


def _matches(df: DataFrame, pattern: str, hint: Column, out: str) -> DataFrame:
    """Add ``out``: array of (start, end, value, before, next) of the pattern's matches in ``_text``."""
    marked = F.regexp_replace("_text", F.lit(f"({pattern})"), F.lit(f"{OPEN}$1{CLOSE}"))
    df = df.withColumn("_marked", F.when(hint, marked))
    has = F.instr("_marked", OPEN) > 0
    df = df.withColumn("_pieces", F.when(has, F.split("_marked", f"[{OPEN}{CLOSE}]", -1)))
    df = df.withColumn("_at", F.when(F.col("_pieces").isNotNull(), _starts("_pieces")))
    kind = "array<struct<start:int,end:int,value:string,before:string,next:string>>"
    made = F.transform(
        "_at",
        lambda s, i: F.struct(
            s.alias("start"),
            (s + F.length(F.get("_pieces", 2 * i + 1))).alias("end"),
            F.get("_pieces", 2 * i + 1).alias("value"),
            F.lower(F.right(F.get("_pieces", 2 * i), F.lit(CONTEXT_CHARS))).alias("before"),
            F.substring(F.get("_pieces", 2 * i + 2), 1, 1).alias("next"),
        ),
    )
    return df.withColumn(out, F.coalesce(made.cast(kind), F.array().cast(kind))).drop("_marked", "_pieces", "_at")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    """The check a match of the strict pattern has to pass."""
    digits = _digits(value)
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(f"^{part}(?:\\.{part}){{3}}$")
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(F.coalesce(good, F.lit(False)), 1).when(F.coalesce(bad, F.lit(False)), -1).otherwise(0)


def _labels(kind: str, m: Column, strict: bool) -> list[Column]:
    """The five labelers' votes on a match."""
    value, before, after = m["value"], m["before"], m["next"]
    digits = _digits(value)
    checks = {
        "email": (F.length(value) <= 254, F.length(value) > 254),
        "ip": (_valid("ip", value), ~_valid("ip", value) & ~value.contains(":")),
        "card": (F.call_function("luhn_check", digits), ~F.call_function("luhn_check", digits)),
        "phone": (F.length(digits).between(9, 15), ~F.length(digits).between(9, 15)),
    }[kind]
    lists = {
        "email": (value.rlike(f"(?i)[. ](?:{TOP_LEVEL})$"), ~value.rlike(f"(?i)[. \\])](?:{TOP_LEVEL})$")),
        "ip": (~value.rlike("^(?:0|255)\\.") & ~value.contains(":"), value.rlike("^(?:0|255)\\.")),
        "card": (digits.rlike(f"^(?:{ISSUERS})"), ~digits.rlike(f"^(?:{ISSUERS})")),
        "phone": (digits.rlike(f"^(?:00)?(?:{CALLING_CODES})"), digits.rlike("^0{3}|^(?:00)?(?:999|000)")),
    }[kind]
    edge = F.coalesce(F.right(before, F.lit(1)), F.lit("")).rlike("[a-z0-9]") | after.rlike("[A-Za-z0-9]")
    votes = [
        _vote(F.lit(strict), F.lit(False)),
        _vote(*checks),
        _vote(*lists),
        _vote(before.rlike(CUES[kind]), before.rlike(AGAINST[kind])),
        _vote(~edge, edge),
    ]
    return [v.cast("int").alias(name) for v, name in zip(votes, LABELERS, strict=True)]


def _features(kind: str, m: Column) -> list[Column]:
    """Small whole numbers that describe a match, by the names of FEATURES."""
    value, n = m["value"], F.length(m["value"])
    found = {
        "size": F.when(n <= 8, 0).when(n <= 16, 1).when(n <= 24, 2).otherwise(3),
        "groups": F.least(F.size(F.array_remove(F.split(value, "[^0-9]+"), "")), F.lit(5)),
        "letters": value.rlike("[A-Za-z]").cast("int"),
        "spaces": value.rlike("[ \\t\\n]").cast("int"),
        "near": F.right(m["before"], F.lit(NEAR_CHARS)).rlike(CUES[kind]).cast("int"),
    }
    return [found[name].alias(name) for name in FEATURES]


def candidates(docs: DataFrame) -> DataFrame:
    """``docs`` (with a text column) and ``_spans``: every candidate span as
    (start, kind, end, base, votes, shape), by start and kind."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    dirty = (F.instr(text, OPEN) > 0) | (F.instr(text, CLOSE) > 0)
    df = docs.withColumn("_text", F.when(dirty, F.translate(text, OPEN + CLOSE, PLAIN * 2)).otherwise(text))
    found = []
    for k, kind in enumerate(KINDS):
        for strict, pattern, hint in ((True, BASE[kind], HINT[kind]), (False, WIDE[kind], WIDE_HINT[kind])):
            name = f"_{kind}_{'base' if strict else 'wide'}"
            df = _matches(df, pattern, hint(F.col("_text")), name)
            found.append((name, k, kind, strict))

    def spans(name, k, kind, strict):
        return F.transform(
            name,
            lambda m: F.struct(
                m["start"].alias("start"),
                F.lit(k).alias("kind"),
                m["end"].alias("end"),
                (_valid(kind, m["value"]) if strict else F.lit(False)).alias("base"),
                F.struct(*_labels(kind, m, strict)).alias("votes"),
                F.struct(*_features(kind, m)).alias("shape"),
            ),
        )

    df = df.withColumn("_spans", F.array_sort(F.concat(*[spans(*x) for x in found])))
    return df.drop("_text", *[x[0] for x in found])


def vote_counts(spans: DataFrame) -> list[tuple[int, tuple[int, ...], tuple[int, ...], int]]:
    """(kind, votes, features, count) over the whole corpus: a table of bounded size."""
    rows = spans.select(F.explode("_spans").alias("s")).select("s.kind", "s.votes.*", "s.shape.*")
    counted = rows.groupBy("kind", *LABELERS, *FEATURES).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["kind"], tuple(r[x] for x in LABELERS), tuple(r[x] for x in FEATURES), r["n"]) for r in counted)


def reliabilities(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list, list[float]]:
    """Expectation-maximisation over vote patterns of one kind.

    Returns the prior, each labeler's vote probabilities given (false, true)
    and every pattern's posterior. It starts from labelers that are right more
    often than not; one pseudo-observation a cell keeps them off 0 and 1.
    """
    start = {1: (0.2, 0.7), 0: (0.4, 0.2), -1: (0.4, 0.1)}
    tables = [{v: list(p) for v, p in start.items()} for _ in LABELERS]
    prior, post = 0.5, []
    for _ in range(rounds):
        post = []
        for votes, _n in patterns:
            logs = [math.log(1 - prior), math.log(prior)]
            for table, v in zip(tables, votes, strict=True):
                for c in (0, 1):
                    logs[c] += math.log(table[v][c])
            post.append(1 / (1 + math.exp(min(700, max(-700, logs[0] - logs[1])))))
        total = sum(n for _, n in patterns)
        mass = sum(n * p for (_, n), p in zip(patterns, post, strict=True))
        prior = min(0.999, max(0.001, (mass + 1) / (total + 2)))
        for k, table in enumerate(tables):
            for c in (0, 1):
                sums = {v: start[v][c] * 3 for v in start}
                for (votes, n), p in zip(patterns, post, strict=True):
                    sums[votes[k]] += n * (p if c else 1 - p)
                whole = sum(sums.values())
                for v in start:
                    table[v][c] = sums[v] / whole
    return prior, tables, post


def _active(votes: tuple[int, ...], shape: tuple[int, ...]) -> list[int]:
    """Which of the classifier's 0/1 inputs are 1: the bias, each vote for or against, each feature's value."""
    out = [0] + [1 + 2 * i + (v < 0) for i, v in enumerate(votes) if v]
    at = 1 + 2 * len(LABELERS)
    for value, n in zip(shape, FEATURES.values(), strict=True):
        out.append(at + value)
        at += n
    return out


def classifier(rows: list[tuple[tuple[int, ...], tuple[int, ...], int, float]], steps: int = 400) -> list[float]:
    """Logistic regression of the posteriors on votes and features, from (votes, features, count, posterior)."""
    weights = [0.0] * (1 + 2 * len(LABELERS) + sum(FEATURES.values()))
    total = sum(n for _, _, n, _ in rows)
    active = [(_active(votes, shape), n, p) for votes, shape, n, p in rows]
    for _ in range(steps if total else 0):
        slope = [0.0] * len(weights)
        for own, n, p in active:
            z = sum(weights[i] for i in own)
            miss = n / total * (p - 1 / (1 + math.exp(-max(-50, min(50, z)))))
            for i in own:
                slope[i] += miss
        weights = [w + 1.0 * (s - 1e-4 * w) for w, s in zip(weights, slope, strict=True)]
    return weights


def train(counts: list[tuple[int, tuple[int, ...], tuple[int, ...], int]]) -> dict[int, list[float]]:
    """The span classifier's weights of each kind."""
    models = {}
    for k in range(len(KINDS)):
        own = [(votes, shape, n) for kind, votes, shape, n in counts if kind == k]
        merged: dict[tuple[int, ...], int] = {}
        for votes, _, n in own:
            merged[votes] = merged.get(votes, 0) + n
        patterns = sorted(merged.items())
        post = reliabilities(patterns)[2] if patterns else []
        chance = {votes: p for (votes, _), p in zip(patterns, post, strict=True)}
        models[k] = classifier([(votes, shape, n, chance[votes]) for votes, shape, n in own])
    return models


def _accepted(span: Column, models: dict[int, list[float]]) -> Column:
    out = F.lit(False)
    for k, weights in models.items():
        score = F.lit(float(weights[0]))
        for i, name in enumerate(LABELERS):
            vote = span["votes"][name]
            score = score + F.when(vote == 1, float(weights[1 + 2 * i])).when(vote == -1, float(weights[2 + 2 * i])).otherwise(0.0)
        at = 1 + 2 * len(LABELERS)
        for name, n in FEATURES.items():
            score = score + F.element_at(F.array(*[F.lit(float(w)) for w in weights[at : at + n]]), span["shape"][name] + 1)
            at += n
        out = F.when(span["kind"] == k, score >= math.log(ACCEPT / (1 - ACCEPT))).otherwise(out)
    return out


def decided(df: DataFrame, models: dict[int, list[float]]) -> DataFrame:
    """Replace ``_spans`` by ``_base`` and ``_all``: the base spans, and these
    with the accepted candidates that overlap none of them."""
    df = df.withColumn("_base", F.filter("_spans", lambda s: s["base"]))
    more = F.filter(
        F.filter("_spans", lambda s: ~s["base"] & _accepted(s, models)),
        lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])),
    )
    return df.withColumn("_all", F.array_sort(F.concat("_base", more))).drop("_spans")


def _listed(spans: str) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every text of ``docs`` (doc_id, text).

    Returns doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256
    and spans ("kind:start:end" by start, comma-joined). A null text is empty
    and has no spans. Rows are treated one by one: repeated rows and repeated
    or null doc_ids give a row each. Very long texts are searched whole. Of
    candidates that overlap each other all accepted ones are listed; none that
    overlaps a base span is. Other columns, whatever their names, are ignored.
    An empty table gives no rows.
    """
    slim = candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "_spans")
    slim = materialize(slim, "pii-candidates")
    done = decided(slim, train(vote_counts(slim)))

    def number(k: int) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [number(k) for k in range(len(KINDS))]
    return done.select("doc_id", *counts, F.sha2(_listed("_base"), 256).alias("base_sha256"), _listed("_all").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in text replaced by [EMAIL], [IP], [CARD] or
    [PHONE]; overlapping spans become one, named after the first. Where there
    is an n_chars column it is brought up to date for the changed texts.

    The candidates are found once and written beside the rows. Null and empty
    texts stay as they are, very long ones are searched whole, repeated rows
    are treated one by one, columns of any name pass through, and an empty
    table stays empty."""
    columns = docs.columns
    # By position, so that no column is called like one used here.
    inside = {c: c if c == "text" else f"c_{i}" for i, c in enumerate(columns)}
    found = candidates(docs.toDF(*inside.values()))
    found = materialize(found, "pii-candidates")
    done = decided(found, train(vote_counts(found)))
    empty = F.slice("_all", 1, 0)
    merged = F.aggregate(
        "_all",
        empty,
        lambda a, s: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] > s["start"]),
                            F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.element_at(a, -1).withField("end", F.greatest(F.element_at(a, -1)["end"], s["end"])))))
        .otherwise(F.concat(a, F.array(s))),
    )
    tags = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    done = done.withColumn("_cut", F.when(F.size("_all") > 0, merged))
    parts = F.transform(
        "_cut",
        lambda s, i: F.concat(
            F.substring("text", F.when(i == 0, 0).otherwise(F.get("_cut", i - 1)["end"]) + 1,
                        s["start"] - F.when(i == 0, 0).otherwise(F.get("_cut", i - 1)["end"])),
            F.get(tags, s["kind"]),
        ),
    )
    rest = F.expr("substring(text, element_at(_cut, -1).end + 1)")
    done = done.withColumn("_new", F.when(F.col("_cut").isNotNull(), F.concat(F.array_join(parts, ""), rest)))
    named = []
    for c in columns:
        if c == "text":
            named.append(F.coalesce("_new", "text").alias("text"))
        elif c == "n_chars":
            kind = docs.schema[c].dataType
            named.append(F.when(F.col("_new").isNotNull(), F.length("_new").cast(kind)).otherwise(F.col(inside[c])).alias(c))
        else:
            named.append(F.col(inside[c]).alias(c))
    return done.select(*named)


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def pii_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Redact the personal data in every document: :func:`redact`, which states the odd cases."""
    return redact(docs)
