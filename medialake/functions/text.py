"""Words, tokens and excerpts as Column builders."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column

# Words without discriminating power.
STOP_WORDS = (
    "a an and are as at be but by for from has have he in is it its of on or that the this to was were will with you your i we they so if not can do does"
).split()

TOKEN_BREAK = r"[^\p{L}\p{N}]+"
PHRASE_BREAK = r"[^\p{L}\p{N}']+"


def tokens(text: Column | str) -> Column:
    """Lower-case letter and digit runs of two characters or more, without stop words."""
    text = F.col(text) if isinstance(text, str) else text
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_BREAK)
    return F.filter(parts, lambda t: (F.length(t) > 1) & ~t.isin(STOP_WORDS))


def phrase_words(text: Column | str) -> Column:
    """Lower-case words; apostrophes belong to a word, and stop words stay."""
    text = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), PHRASE_BREAK), "")


def weighted_tokens(title: Column | str, text: Column | str) -> Column:
    """A document's tokens with the title's counted twice."""
    own = tokens(title)
    return F.concat(own, own, tokens(text))


def excerpt(text: Column | str, terms: list[str], radius: int = 120) -> Column:
    """A window around the earliest term, with an ellipsis at each side where something is left out."""
    text = F.col(text) if isinstance(text, str) else text
    low = F.lower(text)
    places = [F.nullif(F.instr(low, F.lit(t)), F.lit(0)) for t in dict.fromkeys(terms)]
    found = F.array_min(F.array(*places)) if places else F.lit(None).cast("int")
    at = found - 1
    begin = F.greatest(at - radius, F.lit(0))
    end = F.least(at + radius, F.length(text))
    part = F.concat(
        F.when(begin > 0, "…").otherwise(""), F.trim(F.substring(text, begin + 1, end - begin)), F.when(end < F.length(text), "…").otherwise("")
    )
    return F.when(found.isNull(), F.trim(F.substring(text, 1, 2 * radius))).otherwise(part)


def collapse_blanks(text: Column | str) -> Column:
    """Any run of white space, Unicode's included, as one blank; none at either end."""
    text = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(text, "(?U)[\\s\\x{FEFF}]+", " "))


def word_count(text: Column | str) -> Column:
    text = F.col(text) if isinstance(text, str) else text
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), "(?U)[\\s\\x{FEFF}]+"), ""))


def text_window(text: Column | str, offset: int = 0, max_chars: int | None = None) -> Column:
    """``text, truncated, total_chars, next_offset``: a window that prefers to end at a blank."""
    text = F.col(text) if isinstance(text, str) else text
    total = F.length(text)
    begin = F.least(F.lit(max(0, offset)), total)
    if max_chars is None:
        return F.struct(F.substring(text, begin + 1, total).alias("text"), F.lit(False).alias("truncated"), total.alias("total_chars"), F.lit(None).cast("int").alias("next_offset"))
    hard = begin + max_chars
    soft = hard + 1 - F.nullif(F.instr(F.reverse(F.substring(text, F.lit(1), hard + 1)), F.lit(" ")), F.lit(0))
    end = F.when(soft > begin, soft).otherwise(hard)
    whole = hard >= total
    return F.struct(
        F.when(whole, F.substring(text, begin + 1, total)).otherwise(F.substring(text, begin + 1, end - begin)).alias("text"),
        (~whole).alias("truncated"), total.alias("total_chars"), F.when(~whole, end).alias("next_offset"),
    )


def ngrams(words: Column, n: int) -> Column:
    """All runs of ``n`` words, joined by blanks."""
    return F.when(
        F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    ).otherwise(F.array().cast("array<string>"))
