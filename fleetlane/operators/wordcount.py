"""Text family: word count (O25/O26/O39), input-set summary (O01),
bag union of inputs (O42) and the per-task report (K5).

All of it is explode + hash aggregate: the partial aggregate runs before
the shuffle, so a hot word (or a hot input set) is pre-summed on every
executor and only one row per (key, map task) crosses the network.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlane.functions.text import text_lines, tokens


def explode_words(df: DataFrame, text_col: str = "text",
                  keep: Sequence[str] = ()) -> DataFrame:
    """One row per token (``word``), carrying the ``keep`` columns."""
    out = df.select(*keep, F.explode(tokens(F.col(text_col))).alias("word"))
    return out.where(F.col("word") != "")


def wordcount(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, cnt) over every token of every row."""
    return (explode_words(df, text_col)
            .groupBy("word")
            .agg(F.count(F.lit(1)).alias("cnt")))


def wordcount_by_set(df: DataFrame, set_col: str = "input_set",
                     text_col: str = "text") -> DataFrame:
    """(input_set, word, cnt): one independent word count per input set."""
    return (explode_words(df, text_col, keep=[set_col])
            .groupBy(set_col, "word")
            .agg(F.count(F.lit(1)).alias("cnt")))


def wordcount_sorted(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Word count ordered by token in byte order (Spark's binary collation,
    so ``I`` < ``am``).  The sort is a range-partitioned distributed sort."""
    return wordcount(df, text_col).orderBy("word")


def text_scan_summary(df: DataFrame, set_col: str = "input_set",
                      text_col: str = "text") -> DataFrame:
    """Per input set: files, lines and characters (every file of a set is
    read as lines and the files are concatenated)."""
    return (df.groupBy(set_col)
              .agg(F.count(F.lit(1)).alias("n_files"),
                   F.sum(F.size(text_lines(F.col(text_col)))).cast("bigint").alias("n_lines"),
                   F.sum(F.length(text_col)).cast("bigint").alias("n_chars")))


def union_inputs(*parts: DataFrame) -> DataFrame:
    """Bag union of several inputs with the same columns (by name)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The section headers of a task report, in order.
REPORT_HEADERS = ("input :", "wordcount output:", "mkdir output.txt:",
                  "save hdfs to disk")


def task_report_lines(df: DataFrame, task_col: str = "input_set",
                      order_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The report of every task as a long table of lines.

    Columns: task, sec, k_doc, k_line, k_word, line.  A report is the
    concatenation of its rows ordered by (sec, k_doc, k_line, k_word):
    header, the input files' lines, blank, header, ``word<TAB>cnt`` lines
    in byte order, blank, header, blank, header.  Keeping it long (one row
    per line) means no task's report is ever built as one value in one
    executor; the text sink writes it ordered per task.
    """
    inputs = (df.select(F.col(task_col).alias("task"),
                        F.col(order_col).cast("bigint").alias("k_doc"),
                        F.posexplode(text_lines(F.col(text_col))).alias("k_line", "line"))
                .select("task", F.lit(1).alias("sec"), "k_doc",
                        F.col("k_line").cast("bigint").alias("k_line"),
                        F.lit("").alias("k_word"), "line"))
    counts = (wordcount_by_set(df.withColumnRenamed(task_col, "task"), "task", text_col)
              .select("task", F.lit(3).alias("sec"), F.lit(0).cast("bigint").alias("k_doc"),
                      F.lit(0).cast("bigint").alias("k_line"), F.col("word").alias("k_word"),
                      F.concat_ws("\t", "word", F.col("cnt").cast("string")).alias("line")))
    # headers (sec 0,2,5,7) and blank separators (sec 2 blank, 4, 6) per task
    fixed = [(0, REPORT_HEADERS[0]), (2, ""), (2, REPORT_HEADERS[1]), (4, ""),
             (5, REPORT_HEADERS[2]), (6, ""), (7, REPORT_HEADERS[3])]
    tasks = df.select(F.col(task_col).alias("task")).distinct()
    fixed_arr = F.array(*[F.struct(F.lit(s).alias("sec"), F.lit(i).cast("bigint").alias("k"),
                                   F.lit(t).alias("line"))
                          for i, (s, t) in enumerate(fixed)])
    headers = (tasks.select("task", F.explode(fixed_arr).alias("h"))
                    .select("task", F.col("h.sec").alias("sec"), F.lit(0).cast("bigint").alias("k_doc"),
                            F.col("h.k").alias("k_line"), F.lit("").alias("k_word"),
                            F.col("h.line").alias("line")))
    return headers.unionByName(inputs).unionByName(counts)
