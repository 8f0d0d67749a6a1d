"""Text and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Blanks, punctuation, stop words and numeric labels.
# Blanks are spelt out, as a class and one by one: the JVM's \s and \w know only ASCII.
BLANK = r"\t-\r\x1c-\x20\x85\p{Z}"
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
PUNCTUATION_PATTERN = rf"[^\p{{L}}\p{{N}}_{BLANK}]"
MULTIPLE_SPACES_PATTERN = rf"[{BLANK}]+"
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "he", "in",
    "is", "it", "its", "of", "on", "that", "the", "to", "was", "will", "with", "this",
    "but", "they", "have",
)
NUMERIC_LABELS = {"0": "negative", "1": "neutral", "2": "positive"}


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode blanks."""
    return F.btrim(text, F.lit(BLANKS))


def bare_text(text: Column) -> Column:
    """Lower-case, without punctuation."""
    return F.regexp_replace(F.lower(text), PUNCTUATION_PATTERN, "")


def clean_text(text: Column) -> Column:
    """Lower-case, drop punctuation, fold runs of blanks into one space."""
    return F.trim(F.regexp_replace(bare_text(text), MULTIPLE_SPACES_PATTERN, " "))


def word_count(text: Column) -> Column:
    return F.regexp_count(bare_text(text), F.lit(rf"[^{BLANK}]+"))


def tokens(text: Column, drop_stop_words: bool = False) -> Column:
    """Words of the cleaned text; repeated words stay."""
    unwanted = ["", *STOP_WORDS] if drop_stop_words else [""]
    return F.filter(F.split(clean_text(text), " "), lambda w: ~w.isin(unwanted))


def normalise_label(label: Column) -> Column:
    """Strip and lower-case; 0/1/2 become negative/neutral/positive, others stay."""
    plain = strip(F.lower(label))
    names = F.create_map(*[F.lit(x) for pair in NUMERIC_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(names, plain), plain)


def truncate(text: Column, length: int = 100) -> Column:
    """At most ``length`` characters; a cut text ends in three dots."""
    cut = F.concat(F.substring(text, 1, length - 3), F.lit("..."))
    return F.when(F.length(text) > length, cut).otherwise(text)


def preview(text: Column) -> Column:
    """First 50 characters and three dots; null for a missing or empty text."""
    shown = F.concat(F.substring(text, 1, 50), F.lit("..."))
    return F.when(F.length(text) > 0, shown)


def score_text(score: Column) -> Column:
    """Score with four decimals."""
    return F.when(score.isNotNull(), F.format_string("%.4f", score))


def lookup(payload: Column, key: str, default: str | None = None) -> Column:
    """Payload value under ``key``, or the default."""
    return F.coalesce(F.try_element_at(payload, F.lit(key)), F.lit(default).cast("string"))


def percent(part: Column, whole: Column) -> Column:
    """Share of ``whole`` in percent; null when the whole is zero."""
    return F.try_divide(part * F.lit(100.0), whole)
