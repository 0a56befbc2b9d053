"""Counts of a whole text that quality rules and the quality classifier are made from."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.llm.common import quoted, text_or_empty, word_blocks

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct_words",
)
STATISTICS = T.StructType([T.StructField(c, T.LongType()) for c in COUNTS])
STATISTICS_ARROW = pa.struct([(c, pa.int64()) for c in COUNTS])

BLANKS = b" \t\n\x0b\x0c\r"
# Deleting blanks and all but the first byte of each character leaves one byte per character of a word.
NOT_COUNTED = BLANKS + bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
WINDOW_WORDS = 3


def repeated_words(ids: np.ndarray, n_distinct: int) -> int:
    """Words inside windows of three words that occur twice or more, the first included.

    Words are numbers below ``n_distinct``, and so is each step of the packing, so
    equal numbers mean equal windows.
    """
    n = len(ids) - WINDOW_WORDS + 1
    if n < 2:
        return 0
    window = ids[:n]
    for i in range(1, WINDOW_WORDS):
        if n_distinct ** (i + 1) >= 1 << 63:
            _, window = np.unique(window, return_inverse=True)
        window = window * n_distinct + ids[i : i + n]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for i in range(WINDOW_WORDS):
        covered[i : i + n] |= repeated
    return int(covered.sum())


def statistics_of(data: bytes) -> tuple[int, ...]:
    """The counts of one text, in the order of ``COUNTS``."""
    numbers: dict[bytes, int] = {}
    ids = array("q")
    for words in word_blocks(data):
        ids.extend([numbers.setdefault(w, len(numbers)) for w in words])
    lines = [line for line in data.split(b"\n") if line.strip(BLANKS)]
    return (
        len(ids),
        len(data.translate(None, NOT_COUNTED)),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(np.frombuffer(ids, np.int64), len(numbers)) if ids else 0,
        len(lines),
        len(data) - len(data.translate(None, UPPER)),
        len(numbers),
    )


@F.arrow_udf(STATISTICS)
def _statistics(texts: pa.Array) -> pa.Array:
    columns = list(zip(*(statistics_of(t.as_py()) for t in texts))) or [()] * len(COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], COUNTS)


def text_statistics(text: str) -> Column:
    """A struct column with the counts of a whole text; zeros for null and empty texts.

    Words are runs of anything but blank, tab and \\n to \\r. ``word_chars`` counts their
    code points, ``n_symbols`` the signs #*$%&|<>, ``n_lines`` the \\n-split lines with a
    word and ``n_dup_lines`` those equal to an earlier one, ``n_upper`` the letters A-Z.
    """
    return _statistics(text_or_empty(text).cast("binary"))


def with_statistics(docs: DataFrame, id_column: str, text: str, **more: str) -> DataFrame:
    """doc_id and the counts, with further columns under new names; other columns are left out."""
    kept = docs.select(
        F.col(quoted(id_column)).alias("doc_id"),
        *[F.col(quoted(c)).cast("string").alias(n) for n, c in more.items()],
        text_statistics(text).alias("s"),
    )
    return kept.select("doc_id", *more, "s.*")


def share(part: str, whole: str) -> Column:
    """part / whole, 0 of nothing."""
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))
