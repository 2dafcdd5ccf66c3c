"""Payload expressions against Python's own JSON reader."""

import json

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from snapfolio.functions import (
    decode_payload,
    encode_payload,
    has_content,
    is_falsy,
    is_valid_json,
    normalize_key,
    payload_kind,
    strip_key,
)

BODIES = [
    "[]", "{}", "null", "oops", "", "  ", "[1]", '{"a":1}', '{"a":1} xyz', "[1] x", "[1]]",
    '{"a":1}}', '{"a":1}]', '"abc"', '""', '" "', "5", "0", "0.0", "-0", "0e5", "false", "true",
    '{"a":1,"a":2}', '{"historical":null}', "{'a':1}", "[1,", '{"a":', " \n[ ]\t", " { } ",
    "1e400", '1,"x":2', "1,2", '{"a":1},{"b":2}', '{"a":1},"x":2', "[01]", "[1,]", "nul",
    '["\\u00e9\\n"]', "[[]]", "[{}]", '[""]', " []", "[NaN]", '["\t"]',
]


def _python(text):
    try:
        value = json.loads(text)
    except ValueError:
        return False, None, None
    kind = "array" if isinstance(value, list) else "object" if isinstance(value, dict) else "scalar"
    return True, not value, kind


def _check(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    result = df.select(
        "t", is_valid_json(F.col("t")), is_falsy(F.col("t")), payload_kind(F.col("t")),
        has_content(F.col("t")),
    ).collect()
    for text, valid, falsy, kind, content in result:
        expected_valid, expected_falsy, expected_kind = _python(text)
        assert valid == expected_valid, text
        if valid:
            assert (falsy, kind) == (expected_falsy, expected_kind), text
            assert content == (not expected_falsy and kind != "scalar"), text


def test_known_bodies(spark):
    _check(spark, BODIES)


def test_null_body(spark):
    df = spark.createDataFrame([(None,)], "t STRING")
    assert df.select(is_valid_json(F.col("t")), has_content(F.col("t"))).first() == (False, False)


_json = st.recursive(
    st.none() | st.booleans() | st.integers(-10**12, 10**12) | st.floats(allow_nan=False, allow_infinity=False) | st.text(st.characters(exclude_categories=["Cs"]), max_size=8),
    lambda inner: st.lists(inner, max_size=4) | st.dictionaries(st.text(st.characters(exclude_categories=["Cs"]), max_size=4), inner, max_size=4),
    max_leaves=8,
)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values=st.lists(_json, min_size=20, max_size=40), data=st.data())
def test_generated_bodies(spark, values, data):
    texts = [json.dumps(v, ensure_ascii=data.draw(st.booleans())) for v in values]
    # Broken ones as well: cut off or followed by something.
    broken = [t[: data.draw(st.integers(0, len(t)))] for t in texts] + [t + "]" for t in texts]
    _check(spark, texts + broken)


def test_large_payload_is_not_lost(spark):
    """Larger than the 16 MB a VARIANT may have."""
    df = spark.range(1).select(
        F.concat(F.lit('["'), F.repeat(F.lit("x"), 20 << 20), F.lit('"]')).alias("t")
    )
    assert df.select(is_valid_json(F.col("t")), has_content(F.col("t"))).first() == (True, True)


def test_bad_field_becomes_null_alone(spark):
    raw = '[{"date":"2024-01-01","open":"7"},{"date":"2024-01-02","open":1.2E7}]'
    df = spark.createDataFrame([(raw,)], "t STRING")
    decoded = decode_payload(F.col("t"), "ARRAY<STRUCT<date: STRING, open: DOUBLE>>")
    assert [tuple(r) for r in df.select(decoded).first()[0]] == [
        ("2024-01-01", None), ("2024-01-02", 1.2e7),
    ]


def test_encode_keeps_null_fields(spark):
    value = F.struct(F.lit(None).cast("string").alias("a"), F.lit(1).alias("b"))
    assert spark.range(1).select(encode_payload(value)).first()[0] == '{"a":null,"b":1}'


# All white space Python's strip() knows.
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]


def test_strip_like_python(spark):
    texts = [f"{s}a{s}b{s}" for s in SPACES] + ["".join(SPACES), "", "a", "​a"]
    df = spark.createDataFrame([(t,) for t in texts], "t STRING")
    for text, stripped in df.select("t", strip_key(F.col("t"))).collect():
        assert stripped == text.strip(), repr(text)


def test_normalize_key(spark):
    df = spark.createDataFrame(
        [("price", " aapl "), ("price", " "), ("economic", " GDP"), ("news", None)],
        "data_type STRING, symbol STRING",
    )
    keys = df.select(normalize_key(F.col("symbol"), F.col("data_type"))).collect()
    assert [k[0] for k in keys] == ["AAPL", None, "gdp", None]
