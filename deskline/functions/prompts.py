"""Neighbour context lines and the prompt text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskline.constants import (
    CATEGORY_DEFINITIONS,
    CONTEXT_CHARS,
    NO_NEIGHBOURS_TEXT,
    NO_TITLE_TEXT,
    PROMPT_DESCRIPTION,
    PROMPT_HEAD,
    PROMPT_NEIGHBOURS,
    PROMPT_TAIL,
    PROMPT_TITLE,
)
from deskline.functions.numbers import percent_text
from deskline.functions.text import is_filled


def context_line(category: Column, text: Column, similarity: Column) -> Column:
    """One neighbour: - [category] "text..." (similarity: p%)."""
    return F.concat(
        F.lit("- ["),
        F.coalesce(category, F.lit("None")),
        F.lit('] "'),
        F.substring(F.coalesce(text, F.lit("None")), 1, CONTEXT_CHARS),
        F.lit('..." (similarity: '),
        percent_text(similarity),
        F.lit(")"),
    )


def context_text(lines: Column) -> Column:
    """All neighbour lines, or the fixed text when there are none."""
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.array_join(lines, "\n")).otherwise(
        F.lit(NO_NEIGHBOURS_TEXT)
    )


def prompt_text(title: Column, description: Column, context: Column) -> Column:
    """The text a batch inference step is given for one ticket."""
    return F.concat(
        F.lit(PROMPT_HEAD),
        F.lit(CATEGORY_DEFINITIONS),
        F.lit(PROMPT_NEIGHBOURS),
        context,
        F.lit(PROMPT_TITLE),
        F.when(is_filled(title), title).otherwise(F.lit(NO_TITLE_TEXT)),
        F.lit(PROMPT_DESCRIPTION),
        description,
        F.lit(PROMPT_TAIL),
    )
