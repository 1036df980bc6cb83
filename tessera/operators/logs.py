"""Filters and windows on log lines.

Where a record's lines stand in one text, all of it is done within the row: the
``*_of`` functions take and give an array of struct<pos, line> (:func:`numbered`),
so nothing is shuffled. Where lines are rows of their own, ``(src, pos, line)``,
the functions on DataFrames do the same by windows over each source, whose
frames are bounded and stream over the sorted partition.
Null texts have no lines, null lines count as empty; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

# Words of an error line; marks that begin a stack trace.
ERROR_WORDS = "error|exception|traceback|fatal|failed|failure|panic|crash|404|500"
TRACE_MARKS = "traceback|exception|stack trace"


def exploded(df: DataFrame, key: str, text: str) -> DataFrame:
    """(src, pos, line) of a text column; pos from 0."""
    return df.select(F.col(key).alias("src"), F.posexplode(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n")).alias("pos", "line"))


def numbered(text: Column) -> Column:
    """A text's lines as array<struct<pos, line>>; pos from 0. A last line end
    opens no further line."""
    return F.transform(F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n"), lambda x, i: F.struct(i.alias("pos"), x.alias("line")))


def in_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(src, l) with the lines of a text column, as a column of its own."""
    return df.filter(F.col(text).isNotNull()).select(F.col(key).alias("src"), numbered(F.col(text)).alias("l"))


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value made once, wherever the optimizer moves it."""
    return F.transform(F.array(value), then)[0]


def error_lines_of(l: Column) -> Column:  # noqa: E741
    return F.filter(l, lambda x: is_error(x["line"]))


def without_blank_of(l: Column) -> Column:  # noqa: E741
    return F.filter(l, lambda x: ~is_blank(x["line"]))


def without_repeats_of(l: Column) -> Column:  # noqa: E741
    """Without lines equal to the one before them."""
    return _let(l, lambda a: F.filter(a, lambda x, i: (i == 0) | ~x["line"].eqNullSafe(F.get(a, i - 1)["line"])))


def error_context_of(l: Column, before: int = 5, after: int = 10) -> Column:  # noqa: E741
    """Error lines with ``before`` lines before and ``after`` after them."""

    def near(flags: Column, i: Column) -> Column:
        first = F.greatest(i - after, F.lit(0))
        return F.exists(F.slice(flags, first + 1, i + before - first + 1), lambda e: e)

    return _let(l, lambda a: _let(F.transform(a, lambda x: is_error(x["line"])), lambda flags: F.filter(a, lambda x, i: near(flags, i))))


def investigation_view_of(l: Column) -> Column:  # noqa: E741
    """Blank lines and repeats dropped, then error context; all clean lines of a
    text without errors. Positions stay those of the text."""
    return _let(without_repeats_of(without_blank_of(l)), lambda a: _let(error_context_of(a), lambda near: F.when(F.size(near) > 0, near).otherwise(a)))


def head_and_tail_of(l: Column, most: int = 5000, head: int = 500, tail: int = 2000) -> Column:  # noqa: E741
    """The first and last lines of more than ``most``, else all."""
    return _let(l, lambda a: F.when(F.size(a) > most, F.concat(F.slice(a, 1, head), F.slice(a, F.greatest(F.size(a) - tail, F.lit(head)) + 1, F.lit(tail)))).otherwise(a))


def stack_traces_of(l: Column) -> Column:  # noqa: E741
    """array<struct<first_pos, last_pos, trace>>: from a line with a mark to the
    next blank line, that line included; marks inside a trace begin none. Blank
    lines part a text into stretches; each has a trace or none."""
    mark = lambda x: F.coalesce(x["line"].rlike(rf"(?i)(?:{TRACE_MARKS})"), F.lit(False)) & ~is_blank(x["line"])

    def stretches(a: Column) -> Column:
        blank = F.transform(F.filter(a, lambda x: is_blank(x["line"])), lambda x: x["pos"])
        return _let(blank, lambda b: F.when((F.size(b) > 0) & (F.get(b, F.size(b) - 1) == F.size(a) - 1), b).otherwise(F.concat(b, F.array(F.size(a) - 1))))

    def trace(a: Column, marks: Column, first: Column, last: Column) -> Column:
        at = first + F.array_position(F.slice(marks, first + 1, last - first + 1), True).cast("int") - 1
        return _let(at, lambda p: F.when(p >= first, F.struct(p.alias("first_pos"), last.alias("last_pos"), F.array_join(F.transform(F.slice(a, p + 1, last - p + 1), lambda x: F.coalesce(x["line"], F.lit(""))), "\n").alias("trace"))))

    def all_of(a: Column) -> Column:
        return _let(F.transform(a, mark), lambda marks: _let(stretches(a), lambda ends: F.filter(F.transform(ends, lambda last, i: trace(a, marks, F.when(i == 0, 0).otherwise(F.get(ends, i - 1) + 1), last)), lambda t: t.isNotNull())))

    return _let(l, all_of)


def is_error(line: Column) -> Column:
    return F.coalesce(line.rlike(rf"(?i)\b(?:{ERROR_WORDS})\b"), F.lit(False))


def is_blank(line: Column) -> Column:
    return F.coalesce(F.regexp_replace(line, r"\s+", "") == "", F.lit(True))


def error_lines(df: DataFrame) -> DataFrame:
    return df.filter(is_error(F.col("line")))


def without_blank(df: DataFrame) -> DataFrame:
    return df.filter(~is_blank(F.col("line")))


def without_repeats(df: DataFrame) -> DataFrame:
    """Without lines equal to the one before them."""
    before = F.lag("line").over(Window.partitionBy("src").orderBy("pos"))
    return df.withColumn("_b", before).filter(F.col("_b").isNull() | (F.col("_b") != F.col("line"))).drop("_b")


def error_context(df: DataFrame, before: int = 5, after: int = 10) -> DataFrame:
    """Error lines with ``before`` lines before and ``after`` after them."""
    w = Window.partitionBy("src").orderBy("pos").rowsBetween(-after, before)
    return df.withColumn("_e", F.max(is_error(F.col("line")).cast("int")).over(w)).filter("_e = 1").drop("_e")


def stack_traces(df: DataFrame) -> DataFrame:
    """(src, first_pos, last_pos, trace): from a line with a mark to the next
    blank line, that line included; marks inside a trace begin none."""
    w = Window.partitionBy("src").orderBy("pos")
    rows = df.withColumn("seg", F.coalesce(F.sum(is_blank(F.col("line")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    mark = F.coalesce(F.col("line").rlike(rf"(?i)(?:{TRACE_MARKS})"), F.lit(False)) & ~is_blank(F.col("line"))
    rows = rows.withColumn("start", F.min(F.when(mark, F.col("pos"))).over(Window.partitionBy("src", "seg"))).filter("pos >= start")
    lines = F.array_sort(F.collect_list(F.struct("pos", "line")))
    return rows.groupBy("src", "seg").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), lines.alias("l")).select("src", "first_pos", "last_pos", F.array_join(F.transform("l", lambda x: F.coalesce(x["line"], F.lit(""))), "\n").alias("trace"))


def investigation_view(df: DataFrame) -> DataFrame:
    """Blank lines and repeats dropped, then error context; all clean lines of
    a source without errors."""
    clean = without_repeats(without_blank(df))
    clean = clean.withColumn("old", F.col("pos")).withColumn("pos", F.row_number().over(Window.partitionBy("src").orderBy("old")))
    near = Window.partitionBy("src").orderBy("pos").rowsBetween(-10, 5)
    error = is_error(F.col("line")).cast("int")
    flagged = clean.withColumn("_n", F.max(error).over(near)).withColumn("_a", F.max(error).over(Window.partitionBy("src")))
    return flagged.filter("_a = 0 or _n = 1").select("src", F.col("old").alias("pos"), "line")


def head_and_tail(df: DataFrame, most: int = 5000, head: int = 500, tail: int = 2000) -> DataFrame:
    """(src, pos, line, n_lines, was_trimmed): the first and last lines of a
    source of more than ``most`` lines, all of others."""
    sized = df.withColumn("n_lines", F.count("*").over(Window.partitionBy("src")))
    keep = (F.col("n_lines") <= most) | (F.col("pos") < head) | (F.col("pos") >= F.col("n_lines") - tail)
    return sized.filter(keep).withColumn("was_trimmed", F.col("n_lines") > most)


def chunks(df: DataFrame, key: str, text: str, size: int = 200) -> DataFrame:
    """Pieces of ``size`` lines: (parent, chunk_index, total_chunks, start_line,
    end_line, content); lines from 1. Works within the row: no shuffle."""
    if size <= 0:
        raise ValueError("size must be positive")
    rows = df.filter(F.length(text) > 0).select(F.col(key).alias("parent"), F.split(F.regexp_replace(text, r"\r?\n\z", ""), r"\r?\n").alias("l"))
    rows = rows.withColumn("n", F.ceil(F.size("l") / F.lit(size)).cast("int"))
    rows = rows.select("parent", "l", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * size
    return rows.select("parent", "chunk_index", F.col("n").alias("total_chunks"), (start + 1).alias("start_line"), F.least(start + size, F.size("l")).alias("end_line"), F.array_join(F.slice("l", start + 1, F.lit(size)), "\n").alias("content"))
