"""Column expressions over JSON payload text.

Everything is built from Spark's own JSON functions, so it stays in the JVM. The
VARIANT type is not used on purpose: ``try_parse_json`` turns payloads above
16 MB and payloads with a repeated key into NULL, and both are valid payloads.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_JSON_SPACE = " \t\n\r"

# Python's JSON reader refuses single quotes; Spark's accepts them unless told otherwise.
_JSON_OPTIONS = {"allowSingleQuotes": "false"}


def _first_char(text: Column) -> Column:
    return F.substring(F.ltrim(text, F.lit(_JSON_SPACE)), 1, 1)


def _second_char(text: Column) -> Column:
    """First character that is not a space, after the first such character."""
    trimmed = F.ltrim(text, F.lit(_JSON_SPACE))
    return _first_char(F.substr(trimmed, F.lit(2)))


def payload_kind(text: Column) -> Column:
    """``array``, ``object`` or ``scalar``, told from the first character of valid JSON."""
    first = _first_char(text)
    return F.when(first == "[", "array").when(first == "{", "object").otherwise("scalar")


def is_valid_json(text: Column) -> Column:
    """Whether ``text`` is exactly one JSON value.

    Spark's JSON functions ignore whatever follows the first value. Putting the text
    in the middle of an object and asking for the key behind it makes trailing text
    an error; putting it in an array and counting to one rules out ``1, "a": 2``.
    Both only skip over tokens and build no values. ``json_array_length`` does not know
    NaN, which Python reads, so the array is decoded where it gives no answer.
    """
    framed = F.concat(F.lit('{"v":'), text, F.lit(',"__end__":1}'))
    complete = F.from_json(framed, "__end__ INT", _JSON_OPTIONS)["__end__"] == 1
    listed = F.concat(F.lit("["), text, F.lit("]"))
    length = F.coalesce(
        F.json_array_length(listed), F.size(F.from_json(listed, "ARRAY<STRING>", _JSON_OPTIONS))
    )
    return F.coalesce(complete & (length == 1), F.lit(False))


def is_falsy(text: Column) -> Column:
    """Whether valid JSON is null, false, zero, or an empty string, array or object."""
    first, second = _first_char(text), _second_char(text)
    trimmed = F.trim(text, F.lit(_JSON_SPACE))
    return (
        F.when(first == "[", second == "]")
        .when(first == "{", second == "}")
        .when(first == '"', trimmed == '""')
        .when(first.isin("n", "f"), F.lit(True))
        .otherwise(F.coalesce(trimmed.try_cast("double") == 0, F.lit(False)))
    )


def has_content(text: Column) -> Column:
    """Whether a payload is a non-empty array or object; malformed text is not."""
    full = (payload_kind(text) != "scalar") & ~is_falsy(text) & is_valid_json(text)
    return F.coalesce(full, F.lit(False))


def has_member(text: Column, key: str) -> Column:
    """Whether the payload is an object with ``key``, whatever its value."""
    found = member_text(text, key).isNotNull() | F.array_contains(F.json_object_keys(text), key)
    return F.coalesce((payload_kind(text) == "object") & found, F.lit(False))


def member_text(text: Column, key: str) -> Column:
    """The JSON text of a member array or object; NULL if missing, null or malformed."""
    return F.from_json(text, f"`{key}` STRING", _JSON_OPTIONS)[key]


def decode_payload(text: Column, ddl: str) -> Column:
    """JSON text to a value of the declared type; a bad field becomes NULL by itself."""
    return F.from_json(text, ddl, _JSON_OPTIONS)


def encode_payload(value: Column) -> Column:
    """A value to JSON text, keeping fields that are NULL."""
    return F.to_json(value, {"ignoreNullFields": "false"})
