"""Statistics of whole texts as native column expressions.

Words are runs of `[^\\x20\\x09-\\x0D]`. Repeated windows are found by sorting the 64-bit hashes of the
windows: up to 65,536 words the hash and the position share one number, beyond that they are pairs.

Defined results: NULL counts as the empty text, which has 0 of everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = " \t\n\x0b\x0c\r"
COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars", "n_upper", "n_marks", "n_bars",
    "n_digits", "n_lines", "n_distinct",
)
#: What the learned rules look at: shares, so that they hold for any length of text.
SHARES = {
    "n_words": "n_words",
    "word_length": "word_chars / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "marks": "n_marks / greatest(n_words, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "upper": "n_upper / greatest(word_chars, 1)",
    "distinct": "n_distinct / greatest(n_words, 1)",
    "repeated": "n_repeat_words / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "line_words": "n_words / greatest(n_lines, 1)",
}


def _only(text: Column, kept: str) -> Column:
    """Number of the text's characters in a class."""
    return F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("bigint")


def with_statistics(docs: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The columns `keep` (named apart from the statistics) and every statistic, as bigint."""
    df = docs.select(F.struct(*keep).alias("kept"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("t"))
    body = F.btrim("t", F.lit(BLANK))
    split = F.split(body, r"[\x20\x09-\x0D]+")
    words = F.when(body == "", F.array().cast("array<string>")).otherwise(split)
    lines = F.filter(F.split("t", "\n", -1), lambda line: F.btrim(line, F.lit(BLANK)) != "")
    df = df.select("kept", "t", words.alias("words"), lines.alias("lines"))
    hashes = "transform(words, w -> xxhash64(w))"
    df = df.select("kept", "t", "words", "lines", F.expr(hashes).alias("h"))
    windows = """if(size(h) < 3, cast(array() as array<bigint>),
      transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2])))"""
    df = df.select(
        "kept",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("t", r"[\x20\x09-\x0D]+", "")).cast("bigint").alias("word_chars"),
        _only(F.col("t"), r"#*$%&|<>").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.length("t").cast("bigint").alias("n_chars"),
        _only(F.col("t"), "A-Z").alias("n_upper"),
        _only(F.col("t"), "!?").alias("n_marks"),
        _only(F.col("t"), "|").alias("n_bars"),
        _only(F.col("t"), "0-9").alias("n_digits"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("h")).cast("bigint").alias("n_distinct"),
        F.expr(windows).alias("windows"),
    )
    # hash and position in one number, sorted: equal neighbours are windows found before
    some = df.withColumn("bits", F.expr("cast(ceil(log2(size(windows) + 1)) as int)"))
    short = "sort_array(transform(windows, (h, i) -> shiftleft(shiftright(h, bits), bits) | cast(i as bigint)))"
    once = "size(windows) = size(array_distinct(windows))"
    some = some.withColumn("many", F.expr(f"not ({once})"))
    long = "array_sort(transform(windows, (h, i) -> struct(h as h, i as i)))"
    none = "cast(array() as array<{}>)"
    near = f"if(many and size(windows) <= 65536, {short}, {none.format('bigint')})"
    far = f"if(many and size(windows) > 65536, {long}, {none.format('struct<h:bigint,i:int>')})"
    some = some.withColumn("near", F.expr(near)).withColumn("far", F.expr(far))
    near = "shiftright(near[i], bits) = shiftright(near[i {0} 1], bits)"
    both = "filter(sequence(0, size({0}) - 1), i -> (i > 0 and {1}) or (i < size({0}) - 1 and {2}))"
    low = both.format("near", near.format("-"), near.format("+"))
    high = both.format("far", "far[i].h = far[i - 1].h", "far[i].h = far[i + 1].h")
    found = f"""case when size(near) > 0 then transform({low}, i -> cast(near[i] & (shiftleft(1L, bits) - 1) as int))
      when size(far) > 0 then transform({high}, i -> far[i].i) else cast(array() as array<int>) end"""
    some = some.withColumn("found", F.expr(found))
    covered = "cast(size(array_distinct(flatten(transform(found, i -> array(i, i + 1, i + 2))))) as bigint)"
    return some.select("kept.*", *[F.expr(covered).alias(c) if c == "n_repeat_words" else F.col(c) for c in COUNTS])


def with_shares(stats: DataFrame) -> DataFrame:
    """Adds a struct `x` of the shares."""
    return stats.withColumn("x", F.struct(*[F.expr(e).cast("double").alias(n) for n, e in SHARES.items()]))
