import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentiweave.functions import labels, text

SPACES = [chr(c) for c in range(0x110000) if chr(c).isspace()]


def apply(spark, function, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]


def one(spark, function, value):
    return apply(spark, function, value)[0]


def test_normalize_examples(spark):
    found = apply(
        spark,
        text.normalize,
        "  hello   world  https://example.com  ",
        "看这里https://t.cn/abc很好 吧",
        "a http://x.y b",
        "a\x00b",
        None,
        " 　 ",
    )
    assert found == ["hello world", "看这里 吧", "a b", "ab", "", ""]


def test_every_whitespace_character_collapses_and_trims(spark):
    assert len(SPACES) == 29
    found = apply(spark, text.normalize, *(f"{s}a{s}{s}b{s}" for s in SPACES))
    assert found == ["a b"] * 29
    assert apply(spark, text.strip, *(f"{s}a{s}" for s in SPACES)) == ["a"] * 29
    assert apply(spark, text.word_count, *(f"{s}a{s}b" for s in SPACES)) == [2] * 29
    assert apply(spark, text.is_blank, *SPACES) == [True] * 29


def test_moderation_notice(spark):
    found = apply(
        spark,
        text.drop_moderation_notice,
        "很好用的手机 该微博因被投诉违反社区公约",
        "前面\n该微博因被投诉违反\n后面 该微博因被投诉违反",
        "没有提示 ",
    )
    assert found == ["很好用的手机", "前面", "没有提示"]


def test_clean_cuts_notices_only_where_asked(spark):
    raw = "x 该微博因被投诉违反社区公约"
    df = spark.createDataFrame([(raw, "zh"), (raw, "en")], "t string, lang string")
    by_row = [r[0] for r in df.select(text.clean(F.col("t"), F.col("lang"))).collect()]
    assert by_row == ["x", raw]
    assert one(spark, lambda c: text.clean(c, "en"), raw) == raw
    assert one(spark, lambda c: text.clean(c, "en", force_notice=True), raw) == "x"


def test_chunks(spark):
    found = apply(spark, text.chunks, "a" * 300, "", "hello", "b" * 512, "\n" * 257)
    assert [[len(p) for p in pieces] for pieces in found] == [
        [256, 44], [], [5], [256, 256], [256, 1],
    ]
    assert one(spark, lambda c: text.chunks(c, 2), "😀😀😀") == ["😀😀", "😀"]


def test_char_count_is_code_points(spark):
    assert apply(spark, text.char_count, "短文本", "😀", "") == [3, 1, 0]


def test_truncate_tokens(spark):
    assert len(one(spark, lambda c: text.truncate_tokens(c, 32), "word " * 400).split()) == 32
    assert apply(spark, text.truncate_tokens, "", None) == ["", ""]


def test_pluggable_tokenizer(spark):
    pieces = text.Tokenizer(
        split=lambda c: F.regexp_extract_all(c, F.lit("(.)")),
        join=lambda a: F.array_join(a, ""),
        special_tokens=2,
    )
    assert one(spark, lambda c: text.truncate_tokens(c, 3, pieces), "abcdef") == "abc"
    assert one(spark, lambda c: text.token_count(c, pieces), "abcdef") == 8


def test_title_body_merge(spark):
    df = spark.createDataFrame(
        [
            ("Great phone", "Battery lasts all day."),
            ("Title", ""),
            ("Title", None),
            ("...Title", "body . "),
        ],
        "title string, body string",
    )
    found = [
        r[0] for r in df.select(text.merge_title_body(F.col("title"), F.col("body"))).collect()
    ]
    assert found == ["Great phone. Battery lasts all day", "Title", "Title", "Title. body"]


@settings(max_examples=3, deadline=None)
@given(
    st.lists(
        st.text(alphabet=st.sampled_from("aZ.é短😀 \t\n　 /:htps"), max_size=30),
        min_size=40,
        max_size=60,
    )
)
def test_text_functions_follow_python(spark, texts):
    texts = [*texts, "x https://a b", "http://　q"]
    assert apply(spark, text.strip, *texts) == [t.strip() for t in texts]
    assert apply(spark, text.word_count, *texts) == [len(t.split()) for t in texts]
    assert apply(spark, text.dedupe_key, *texts) == [t.strip().lower() for t in texts]
    assert apply(spark, text.is_blank, *texts) == [not t.strip() for t in texts]


@pytest.mark.parametrize(
    ("kind", "values", "expected"),
    [
        ("int", [0, 1, 4, -1, None], [0, 1, None, None, None]),
        (
            "double",
            [0.5, 1.9, -0.5, 2.0, float("nan"), float("inf")],
            [0, 1, 0, None, None, None],
        ),
        ("boolean", [True, False, None], [1, 0, None]),
        (
            "string",
            ["positive", "negative", "1", "unknown", "0.0", " POS ", "　Bad", "good", None],
            [1, 0, 1, None, None, 1, 0, 1, None],
        ),
    ],
)
def test_harmonize(spark, kind, values, expected):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, label {kind}")
    found = df.orderBy("i").select(labels.harmonized(df, "label")).collect()
    assert [r[0] for r in found] == expected


def test_harmonize_decimal(spark):
    df = spark.sql("SELECT CAST(1.5 AS DECIMAL(3, 1)) AS label")
    assert isinstance(df.schema["label"].dataType, T.DecimalType)
    assert df.select(labels.harmonized(df, "label")).first()[0] == 1
