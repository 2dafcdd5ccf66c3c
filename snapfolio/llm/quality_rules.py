"""Quality rules: a ledger of bits.

Every rule is evaluated once per document. The ledger keeps the measurements and one bit per
rule that failed; a policy is a mask of bits, so another policy, or the effect of leaving a
rule out, needs the ledger only and never the texts.

A null text counts as an empty one. Texts without words have measurements of 0. Repeated rows
and rows without id are judged like any other. Columns of the input other than the id and
the text are not looked at. The work is done within each row: nothing is shuffled, whatever
the number of equal documents, and time grows with a text's length times its logarithm.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

#: What separates words: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits. Ledgers keep the bits, so new rules go to the end.
RULES = {
    "too_few_words": "n_words < 50",
    "too_repetitive": "100 * n_repeat_words > 50 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 25 * n_words",
    "many_symbols": "10 * n_symbols > 3 * n_words",
    "many_repeated_lines": "2 * n_dup_lines > n_lines",
}

#: Policies by version: the rules that a document must pass.
POLICIES = {
    1: ("too_few_words", "too_repetitive"),
    2: tuple(RULES),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def _without(text: Column, characters: str) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), characters, text)


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BREAK))


def _repeated_windows(words: str, packed: str, bits: str) -> Column:
    """Where the windows start that occur twice, or -1, in the order of ``packed``.

    Equal windows are neighbours in ``packed``; the words are compared as well.
    """
    w, s, p = F.col(words), F.col(packed), F.col(bits)

    def place(value: Column) -> Column:
        return value.bitwiseAND(F.call_function("shiftleft", F.lit(1), p) - 1).cast("int")

    def same(value: Column, k: Column) -> Column:
        other = F.get(s, k)
        i, j = place(value), place(other)
        equal = F.call_function("shiftrightunsigned", value, p) == F.call_function(
            "shiftrightunsigned", other, p
        )
        for step in range(3):
            equal = equal & (F.get(w, i + step) == F.get(w, j + step))
        return F.coalesce(equal, F.lit(False))

    return F.transform(
        s, lambda v, k: F.when(same(v, k - 1) | same(v, k + 1), place(v)).otherwise(F.lit(-1))
    )


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements of every row."""
    df = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")
    )
    df = df.select("doc_id", "t", _words(F.col("t")).alias("w"))
    n = F.size("w")
    df = df.select(
        "doc_id",
        "w",
        n.cast("long").alias("n_words"),
        F.length(_without(F.col("t"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("t") - F.length(_without(F.col("t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "").alias("lines"),
        # So many bits hold the place of a window.
        F.length(F.bin(n)).alias("bits"),
    )

    # A window's hash with its place in the lowest bits: sorting brings equal windows together.
    def window(i: Column) -> Column:
        w = F.col("w")
        h = F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
        low = F.col("bits")
        high = F.call_function("shiftleft", F.call_function("shiftrightunsigned", h, low), low)
        return high.bitwiseOR(i.cast("long"))

    df = df.withColumn(
        "packed",
        F.when(
            F.size("w") >= 3,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    df = df.withColumn("at", _repeated_windows("w", "packed", "bits"))
    df = df.withColumn("at", F.sort_array(F.filter("at", lambda x: x >= 0)))
    covered = F.transform(
        "at",
        lambda x, k: F.least(F.lit(3), F.coalesce(F.get(F.col("at"), k + 1), x + 3) - x),
    )
    return df.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failed``, whose bit i is set if rule i of ``RULES`` failed."""
    bits = [
        F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
        for i, rule in enumerate(RULES.values())
    ]
    failed = reduce(lambda a, b: a.bitwiseOR(b), bits)
    return measured(docs, id_col, text_col).withColumn("failed", failed)


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def apply_policy(entries: DataFrame, version: int, name: str = "kept") -> DataFrame:
    """Adds whether a document passes all rules of the policy."""
    return entries.withColumn(
        name, F.col("failed").bitwiseAND(F.lit(mask(POLICIES[version])).cast("long")) == 0
    )


def ablations(entries: DataFrame, version: int) -> DataFrame:
    """Per rule of the policy: documents that fail it, and those that fail no other rule,
    which leaving it out would keep. One row per pattern of bits is shuffled."""
    rules = POLICIES[version]
    patterns = entries.groupBy(
        F.col("failed").bitwiseAND(F.lit(mask(rules)).cast("long")).alias("f")
    ).agg(F.count("*").alias("n"))
    each = F.explode(
        F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit"))
                  for r in rules])
    )
    bit = F.col("x.bit")
    return (
        patterns.select("f", "n", each.alias("x"))
        .groupBy("x.rule")
        .agg(
            F.coalesce(F.sum(F.when(F.col("f").bitwiseAND(bit) != 0, F.col("n"))), F.lit(0)).alias("n_failed"),
            F.coalesce(F.sum(F.when(F.col("f") == bit, F.col("n"))), F.lit(0)).alias("n_only"),
        )
    )
