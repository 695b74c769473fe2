"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def tokens(text: Column) -> Column:
    """Lower-cased pieces between white space, punctuation kept."""
    return F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != "")


#: Characters whose upper case is more than one character.
_LONGER = "".join(chr(c) for c in range(0x110000) if len(chr(c).upper()) > 1)


def upper_by_character(text: Column) -> Column:
    """Upper case character by character, which keeps the length; a character whose upper case is longer stays."""
    pieces = F.split(text, f"(?<=[{_LONGER}])|(?=[{_LONGER}])")
    kept = F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(f"^[{_LONGER}]$"), p).otherwise(F.upper(p))), "")
    return F.when(F.length(F.upper(text)) == F.length(text), F.upper(text)).otherwise(kept)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def chunk_id(source: Column, index: Column, content: Column) -> Column:
    """`chunk_` and 16 hexadecimal digits of the SHA-256 of source, index and the first 100 characters."""
    return F.concat(F.lit("chunk_"), F.substring(F.sha2(F.concat_ws(":", source.cast("string"), index.cast("string"), F.substring(content, 1, 100)), 256), 1, 16))


def lines(texts: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """(key, line_no from 1, line) of each text; a final line break ends the last line and begins none."""
    pieces = F.split(F.regexp_replace(F.col(text), r"\r?\n\z", ""), r"\r?\n")
    return texts.select(key, F.posexplode(pieces).alias("i", "line")).select(key, (F.col("i") + 1).alias("line_no"), "line")


def line_range(all_lines: DataFrame, offset: int = 0, limit: int = 400) -> DataFrame:
    """Lines [offset, offset + limit) of each text, counted from 0."""
    return all_lines.where(F.col("line_no").between(offset + 1, offset + limit))


# Words that keyword extraction drops.
STOP_WORDS = ("how", "does", "what", "is", "the", "a", "and", "or", "in", "at", "to", "for")


def keywords(query: Column) -> Column:
    """Words of more than two characters that aren't stop words, then stripped of `?:;,.` at both ends."""
    words = F.filter(F.split(F.lower(query), r"\s+"), lambda w: (w != "") & ~w.isin(*STOP_WORDS) & (F.length(w) > 2))
    return F.transform(words, lambda w: F.regexp_replace(w, r"^[?:;,.]+|[?:;,.]+$", ""))


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def count_of(text: Column, *parts: str) -> Column:
    """How often the (one-character) parts occur in the text."""
    total = F.lit(0)
    for p in parts:
        total = total + F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))
    return total
