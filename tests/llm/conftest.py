import pytest

#: Names of columns that the operators use inside.
INSIDE = """
    id fp key rank file length score n leaky leaky_id _score label windows fold part x h w own to least mask component component_id node hi lo
    _b _n _rn _file _row _text _spans _base _all _cut _new _marked _pieces _at c_text c_lang c0 c1 hash held width found_id found_key hot
    shard slot fraction size key_ predicted held_out learnt row gram costs lang_pred piece start ids_crc32 sequence_id offset before inside
""".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every awkward case: nulls, empty and long texts, repeated
    rows, and extra columns with the names the operators use inside."""
    long_text = "lorem Ipsum dolor, sit amet. " * 4000 + "x" * 20_000
    rows = [
        (1, None, None, None, None),
        (2, "", "en", "a", 0),
        (3, " \n\t ", "en", "a", 4),
        (4, long_text, "en", "a", len(long_text)),
        (5, "One two THREE four five six seven.", "en", "b", 34),
        (5, "One two THREE four five six seven.", "en", "b", 34),
        (6, "one two three four five six seven.", "fr", None, 34),
        (7, "naïve café 😀 ÀÉ", None, "b", 15),
        (8, "short", "de", "b", 5),
        (None, "One two THREE four five six seven.", "en", "b", 34),
        (9, "123 4.5 !!", "en", "b", 10),
    ]
    return spark.createDataFrame([(*r, *[7] * len(INSIDE)) for r in rows], SCHEMA + "".join(f", `{c}` int" for c in INSIDE))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
