"""Quality rules: repetition signals of each text, and cross-document line frequency.

Lines are normalised and hashed; for every host the distinct documents of each line are counted. Lines in more documents
than the host's limit are taken as boilerplate and removed; a document that keeps too few of its words is rejected.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from siltstone.llm.common import map_texts
from siltstone.session import materialize

SYMBOLS, BLANKS = "#*$%&|<>", " \t\n\r\x0b\x0c"
#: A line is boilerplate above both: this many documents of its host, and this share of the host's documents.
LINE_DOCS, LINE_SHARE = 20, 0.01
#: A document is rejected when removal leaves less than this share of its words.
LEAST_KEPT = 0.5
#: Fixed limits of the base rules.
LEAST_WORDS, MOST_REPEATED = 50, 50
LINES = T.ArrayType(T.StructType([T.StructField("h", T.LongType()), T.StructField("w", T.LongType())]))


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in windows found twice or more in the text."""
    windows = list(zip(*(words[i:] for i in range(width))))
    if len(set(windows)) == len(windows):
        return 0
    code: dict = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in windows), np.int64, len(windows))
    often = np.bincount(ids)[ids] > 1
    covered = np.zeros(len(words), bool)
    for i in range(width):
        covered[i : i + len(windows)] |= often
    return int(covered.sum())


def normal_line(line: str) -> str:
    """Lower case, digits as 0, one blank between words: what makes two lines count as the same."""
    return re.sub(r"[0-9]+", "0", " ".join(line.lower().split()))


def signals(text: str | None) -> tuple:
    """``(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines)``; lines: hash and words of each distinct normal line."""
    text = text or ""
    words = text.encode().split()
    seen: set[str] = set()
    dup, lines = 0, {}
    for line in text.split("\n"):
        n = len(line.encode().split()) if line.strip(BLANKS) else 0
        if n:
            dup += line in seen
            seen.add(line)
            h = xxhash.xxh64_intdigest(normal_line(line).encode()) - (1 << 63)
            lines[h] = lines.get(h, 0) + n
    return (
        len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), dup,
        repeated_words(words), [{"h": h, "w": w} for h, w in lines.items()],
    )


def measure(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Add the base signals and the lines of each text; null counts as a text without words."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    fields = [T.StructField(n, T.LongType()) for n in names] + [T.StructField("lines", LINES)]

    def make():
        return lambda texts: dict(zip((*names, "lines"), zip(*map(signals, texts))))

    return map_texts(docs, keep, text_col, make, T.StructType(fields))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE, least_kept: float = LEAST_KEPT) -> DataFrame:
    """Base signals, ``base_failed``, words in removed lines and the verdict ``kept``, one row for every row of ``docs``.

    Each row counts as one document of its host (null: a host of its own name, empty). A line counts once in a document.
    Null and blank texts have no words and fail the base rules; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("")).alias("_host"), F.col(text_col).alias("_text"))
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # fixed once written
    known = materialize(measure(rows, ["_row", "_id", "_host"], "_text"), "quality")
    hosts = known.groupBy("_host").agg(F.count(F.lit(1)).alias("n_docs"))
    lines = known.select("_row", "_host", F.explode("lines").alias("l")).select("_row", "_host", F.col("l.h").alias("h"), F.col("l.w").alias("w"))
    often = lines.groupBy("_host", "h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > line_docs)
    often = often.join(hosts, "_host").where(F.col("n") > F.col("n_docs") * line_share).select("_host", "h")
    removed = lines.join(materialize(often, "quality-lines"), ["_host", "h"]).groupBy("_row").agg(F.sum("w").alias("removed_words"), F.count(F.lit(1)).alias("removed_lines"))
    out = known.drop("lines").join(removed, "_row", "left")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    return out.select(
        F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (left >= F.col("n_words") * least_kept)).alias("kept"), F.coalesce("removed_lines", F.lit(0)).alias("removed_lines"), F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
    )


def op10(docs: DataFrame) -> DataFrame:
    return judge(docs)
