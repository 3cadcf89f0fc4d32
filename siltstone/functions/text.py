"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: What the retrieval tokenizer splits at (white space, ASCII and CJK punctuation).
SEPARATORS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000},.;:!?()\[\]{}<>=#'\"\x{3002}\x{ff0c}\x{ff1b}\x{ff1a}\x{ff01}\x{ff1f}\x{3001}]+"
#: A word or one CJK character; words that graph queries leave out.
TERM = r"[A-Za-z_][A-Za-z0-9_]*|[\x{4e00}-\x{9fff}]"
#: Stop words of graph queries, and where sentences end.
STOPS = ["the", "and", "or", "of", "to", "in", "for", "on", "is", "a", "an", "的", "是", "了", "和"]
SENTENCE_END = r"([\x{3002}\x{ff01}\x{ff1f}\x{ff1b}]|[.!?;](?=\s|$)|\n{2,})"
#: Stands between parts while they are worked out; one in a text is taken for a blank.
MARK = "\u0001"
#: The spaces of Unicode (category Zs), which the ends of strips lose, as SQL's trim takes them off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def tokens(text: Column) -> Column:
    """Retrieval tokens in order: lower case, split at SEPARATORS, no empty ones; null has none."""
    # most characters are letters, which the look ahead tells apart at once
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "(?![a-z0-9])" + SEPARATORS), lambda x: x != "")


def terms(text: Column) -> Column:
    """Words and single CJK characters in order, lower case."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TERM), F.lit(0)), F.lower)


def term_set(text: Column) -> Column:
    return F.array_distinct(terms(text))


def graph_terms(text: Column) -> Column:
    """Terms without stop words, repeats included."""
    return F.filter(terms(text), lambda t: ~t.isin(STOPS))


def overlap(question: Column, other: Column) -> Column:
    """Share of the question's distinct terms that the other set has; 0 for a question without terms."""
    return F.when(F.size(question) > 0, F.size(F.array_intersect(question, other)) / F.size(question)).otherwise(F.lit(0.0))


def sentences(text: Column, min_chars: int = 6) -> Column:
    """Sentences with their end marks: CJK end marks, ASCII ones before white space, blank lines; short ones join the sentence before."""
    cut = F.split(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), MARK, " "), SENTENCE_END, "$1" + MARK), MARK)
    clean = F.filter(F.transform(cut, lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")
    return glue_short(clean, min_chars)


def glue_short(parts: Column, min_chars: int) -> Column:
    """Parts shorter than ``min_chars`` stick to the one before; the first always stands. One pass: marks, one join, one split."""
    marked = F.transform(parts, lambda s, i: F.concat(F.when(i == 0, F.lit("")).when(F.char_length(s) < min_chars, F.lit(" ")).otherwise(F.lit(MARK)), s))
    return F.filter(F.split(F.array_join(marked, ""), MARK), lambda s: s != "")


def strips(text: Column, marks_cut: bool = False) -> Column:
    """Sentences for refinement: cut behind any of the six end marks, white space collapsed, no spaces of any kind at the ends.

    ``marks_cut``: a MARK in the text cuts too, and is no blank.
    """
    bare = lambda s: F.trim(s, F.lit(SPACES))
    whole = F.coalesce(text, F.lit(""))
    flat = bare(F.regexp_replace(whole if marks_cut else F.translate(whole, MARK, " "), r"\s+", " "))
    cut = F.split(F.regexp_replace(flat, r"([\x{3002}\x{ff01}\x{ff1f}.!?]) *", "$1" + MARK), MARK)
    return F.filter(F.transform(cut, bare), lambda s: s != "")


def hash_vector(text: Column) -> Column:
    """32 numbers from 0 to 1 from the bytes of SHA-256; a repeated tiling has the same cosines."""
    # the digest is an array of one, so that it is worked out once and not for each of its bytes
    byte = lambda d, i: F.conv(F.substring(d, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0
    return F.transform(F.array(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)), lambda d: F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: byte(d, i)))[0]


def point_id(key: Column) -> Column:
    """MD5 of a key laid out as a UUID."""
    h = F.md5(key.cast("string").cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def preview(text: Column, limit: int = 200) -> Column:
    return F.when(F.char_length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(text)


def rewrite_question(question: Column, hints: list[tuple[str, str]]) -> Column:
    """Trimmed, white space collapsed; the tag of each hint whose pattern occurs is appended where it is missing."""
    q = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " "))
    tags = [F.when(q.rlike(p) & ~F.contains(q, F.lit(tag)), F.lit(tag)) for p, tag in hints]
    return F.when(q == "", q).otherwise(F.concat_ws(" ", q, *tags))


def unified_diff(file: Column, old: Column, new: Column) -> Column:
    """A diff of whole files: all old lines out, all new lines in."""
    a, b = F.split(old, "\n"), F.split(new, "\n")
    lines = lambda sign, x: F.array_join(F.transform(x, lambda s: F.concat(F.lit(sign), s, F.lit("\n"))), "")
    head = F.concat(F.lit("--- a/"), file, F.lit("\n+++ b/"), file, F.lit("\n@@ -1,"), F.size(a).cast("string"), F.lit(" +1,"), F.size(b).cast("string"), F.lit(" @@\n"))
    return F.concat(head, lines("-", a), lines("+", b))
