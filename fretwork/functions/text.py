"""Text expressions: optional filters, phrases, quoted prices, display helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# A customer message with one of these phrases asks for a human.
ESCALATION_PHRASES = [
    "speak to a human",
    "talk to a person",
    "real person",
    "sales engineer",
    "talk to someone",
    "human",
    "person",
    "representative",
    "rep",
]

# Fixed pattern: a dollar sign, a digit, further digits and commas, optional decimals.
PRICE_PATTERN = r"\$(\d[\d,]*(?:\.\d+)?)"


def is_blank(col: Column) -> Column:
    """True for NULL and for the empty string: both mean that the caller gave no value."""
    return col.isNull() | (col == "")


def contains_ci(col: Column, text: Column) -> Column:
    """Case-insensitive substring test; ``%`` and ``_`` have no special meaning."""
    return F.contains(F.lower(col), F.lower(text))


def optional_contains(text: Column, *cols: Column) -> Column:
    """Filter that passes when ``text`` is blank or when one of ``cols`` contains it."""
    hit = F.lit(False)
    for col in cols:
        hit = hit | F.coalesce(contains_ci(col, text), F.lit(False))
    return is_blank(text) | hit


# The skill levels in ascending order.
LEVELS = ["beginner", "intermediate", "advanced"]


def _level_range(levels: Column) -> tuple[Column, Column]:
    """Lowest and highest position that a range names; NULL where it names no known level."""
    known = F.array(*[F.lit(x) for x in LEVELS])
    places = F.filter(F.transform(F.split(F.lower(levels), "\\-"), lambda x: F.array_position(known, F.trim(x))), lambda p: p > 0)
    return F.array_min(places), F.array_max(places)


def levels_overlap(levels: Column, wanted: Column) -> Column:
    """True when two skill ranges ("beginner-advanced" spans all levels between) share a level; else false, or NULL for unknown ones."""
    low, high = _level_range(levels)
    wanted_low, wanted_high = _level_range(wanted)
    return (low <= wanted_high) & (wanted_low <= high)


def or_default(col: Column, default: str) -> Column:
    """Display value: NULL and the empty string become ``default``."""
    return F.when(is_blank(col), F.lit(default)).otherwise(col)


def lookup(key: Column, table: dict[str, str], default: Column | str) -> Column:
    """Label for ``key``; ``default`` (a column or a text) where the table has none."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    fallback = F.lit(default) if isinstance(default, str) else default
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), fallback)


def head(col: Column, n: int) -> Column:
    """First ``n`` characters; NULL becomes the empty string."""
    return F.coalesce(F.substring(col, 1, n), F.lit(""))


def ellipsis(col: Column, n: int) -> Column:
    """Text cut to ``n`` characters plus dots where it is longer; shorter text and NULL stay."""
    return F.when(F.length(col) > n, F.concat(F.substring(col, 1, n), F.lit("..."))).otherwise(col)


def escape_dollar(col: Column) -> Column:
    return F.replace(col, F.lit("$"), F.lit("&#36;"))


def join_parts(parts: Column) -> Column:
    """Reply text: the non-empty parts of an array, joined and trimmed."""
    return F.trim(F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), ""))


def quoted_prices(text: Column) -> Column:
    """All dollar amounts in a text, as an array of doubles in reading order."""
    found = F.regexp_extract_all(text, F.lit(PRICE_PATTERN), F.lit(1))
    return F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))


def phrase_array(phrases: Sequence[str]) -> Column:
    return F.array(*[F.lit(p) for p in phrases]).cast("array<string>")


def _select_phrases(text: Column, phrases: Column, present: bool) -> Column:
    """The one-element array binds the lower-case text to a variable, so it is made once, not per phrase."""
    lowered = F.array(F.lower(F.coalesce(text, F.lit(""))))

    def chosen(body: Column) -> Column:
        return F.filter(phrases, lambda p: F.contains(body, F.lower(p)) == F.lit(present))

    return F.element_at(F.transform(lowered, chosen), 1)


def found_phrases(text: Column, phrases: Column) -> Column:
    """Phrases of the array that occur in the text (case-insensitive), in array order."""
    return _select_phrases(text, phrases, True)


def missing_phrases(text: Column, phrases: Column) -> Column:
    """Phrases of the array that do not occur in the text, in array order."""
    return _select_phrases(text, phrases, False)


def asks_for_human(text: Column, phrases: Sequence[str] = ESCALATION_PHRASES, whole_words: bool = False) -> Column:
    """True when a message asks for a human.

    Plain substrings by default, so "rep" also matches "repair"; ``whole_words`` matches at word bounds.
    """
    if whole_words:
        return F.lower(F.coalesce(text, F.lit(""))).rlike(r"\b(" + "|".join(phrases) + r")\b")
    return F.size(found_phrases(text, phrase_array(phrases))) > 0
