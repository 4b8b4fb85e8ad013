"""Ticket texts: defaults, concatenations and the memo key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskline.constants import DEFAULT_TITLE_CHARS, MEMO_HEX_CHARS, MEMO_PREFIX

# Every character Unicode counts as white space when splitting
# words, plus the four ASCII separators U+001C..U+001F.  Java's \s misses most.
WHITESPACE = (
    "[\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000]+"
)
# The part of it below U+0100, which Java matches several times faster, and the
# range all the others lie in.
WHITESPACE_LATIN = "[\\t\\n\\x0B\\f\\r\\x1c-\\x1f \\x85\\xa0]+"
WIDE_RANGE = "[\\u1680-\\u3000]"


def is_filled(text: Column) -> Column:
    """True for a non-null, non-empty text; never null."""
    return F.coalesce(text != "", F.lit(False))


def stored_title(title: Column, description: Column) -> Column:
    """The title, or the opening characters of the description without one."""
    return F.when(is_filled(title), title).otherwise(F.substring(description, 1, DEFAULT_TITLE_CHARS))


def ticket_text(title: Column, description: Column) -> Column:
    """The text that is classified and memoised: uses the title as sent."""
    return F.when(is_filled(title), F.concat(title, F.lit(". "), description)).otherwise(description)


def vector_text(title: Column, description: Column) -> Column:
    """The text that is stored with the vector: uses the stored title."""
    return F.concat(stored_title(title, description), F.lit(". "), description)


def folded(text: Column) -> Column:
    """Lower case, white space runs as one space, none at the edges."""
    lowered = F.lower(text)
    spaced = F.when(
        F.rlike(lowered, F.lit(WIDE_RANGE)), F.regexp_replace(lowered, WHITESPACE, " ")
    ).otherwise(F.regexp_replace(lowered, WHITESPACE_LATIN, " "))
    return F.trim(spaced)


def memo_key(text: Column) -> Column:
    """The key under which the result for a text is remembered."""
    return F.concat(F.lit(MEMO_PREFIX), F.substring(F.sha2(folded(text), 256), 1, MEMO_HEX_CHARS))
