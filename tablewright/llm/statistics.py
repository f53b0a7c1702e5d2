"""Statistics of a text as column expressions, computed over the whole text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.tables import SPACE, WORD

WINDOW = 5
#: What learned rules may look at; each is a number that is 0 for an empty text.
FEATURES = ("n_words", "mean_word", "symbols_per_word", "dup_line_part", "repeat_part", "upper_part", "marks_per_word", "digit_part", "distinct_part", "stops_per_word")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` mentions it."""
    return F.transform(F.array(value), then)[0]


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows of ``window`` words that are found twice or more, the first included.

    Windows are compared by 64-bit hashes. Texts without a repeated window need no more than a set of the hashes.
    """

    def covered(w: Column) -> Column:
        places = F.array_sort(F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def found(s: Column) -> Column:
            again = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, j + 1)["h"].eqNullSafe(x["h"])))
            starts = F.array_sort(F.transform(again, lambda x: x["i"]))
            zero = F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto"))
            step = lambda a, p: F.struct((a["total"] + p + window - F.greatest(a["upto"], p)).alias("total"), (p + window).alias("upto"))
            return F.aggregate(starts, zero, step, lambda a: a["total"])

        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(places, found))

    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - (window - 1)), lambda i: F.xxhash64(F.slice(h, i, window)))
    return F.when(F.size(hashes) <= window, F.lit(0)).otherwise(let(windows(hashes), covered))


def with_statistics(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """``keep`` columns, the counts of each text, and ``FEATURES``; NULL text counts as empty."""
    whole = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(*keep, F.struct(whole.alias("text"), F.length(whole).alias("chars"), F.transform(words(whole), lambda w: F.xxhash64(w)).alias("hashes")).alias("_t"))
    lines = F.filter(F.split(F.col("_t.text"), "\n"), lambda line: F.rlike(line, F.lit(WORD)))
    count = lambda pattern: F.regexp_count(F.col("_t.text"), F.lit(pattern)).cast("bigint")
    counts = base.select(
        *keep, F.size("_t.hashes").cast("bigint").alias("n_words"), (F.col("_t.chars") - count(SPACE)).cast("bigint").alias("word_chars"), count(r"[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.struct(F.size(x).alias("lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("again"))).alias("_lines"),
        repeated_words(F.col("_t.hashes")).cast("bigint").alias("n_repeat_words"), F.size(F.array_distinct("_t.hashes")).alias("_distinct"),
        count(r"\p{Lu}").alias("_upper"), count(r"[!?]").alias("_marks"), count(r"[0-9]").alias("_digits"), count(r"[.,]").alias("_stops"))
    part = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return counts.withColumns({"_n_lines": F.col("_lines.lines"), "n_dup_lines": F.col("_lines.again").cast("bigint")}).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", part("word_chars", "n_words").alias("mean_word"),
        part("n_symbols", "n_words").alias("symbols_per_word"), part("n_dup_lines", "_n_lines").alias("dup_line_part"),
        part("n_repeat_words", "n_words").alias("repeat_part"), part("_upper", "word_chars").alias("upper_part"), part("_marks", "n_words").alias("marks_per_word"),
        part("_digits", "word_chars").alias("digit_part"), part("_distinct", "n_words").alias("distinct_part"), part("_stops", "n_words").alias("stops_per_word"))


def label_of(labels: DataFrame, column: str) -> DataFrame:
    """``doc_id, label``: one row per labelled document; contradicting labels count as the smaller, NULL as none."""
    return labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(column).cast("int").alias("label"))
