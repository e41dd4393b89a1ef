"""Tokenising and whitespace helpers for text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word-count tokenizer splits on exactly these five
# characters (space, tab, newline, carriage return, form feed); case and
# punctuation are kept, empty tokens are dropped.
TOKEN_DELIMS = " \t\n\r\f"
TOKEN_SPLIT_RE = "[ \\t\\n\\r\\f]+"

# Characters removed by a whole-text strip (reports, job output).
STRIP_CHARS = " \t\n\r\f\u000b"


def tokens(text: Column) -> Column:
    """Array of whitespace-separated tokens; may contain one leading ''."""
    return F.split(text, TOKEN_SPLIT_RE)


def strip_ws(text: Column) -> Column:
    """Remove leading and trailing whitespace (all six ASCII space chars)."""
    return F.trim(text, F.lit(STRIP_CHARS))


def text_lines(text: Column) -> Column:
    """Split a text into its lines (LF separated, as the text reader does)."""
    return F.split(text, "\n")
