"""From a model's raw answer text to a checked classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from deskline.constants import ANSWER_DEFAULT_CONFIDENCE, CATEGORIES, DEFAULT_CATEGORY
from deskline.functions.numbers import clamped

# A fenced block around the JSON text, and the spellings of a
# number that are accepted in a text field.
FENCE = r"(?s)```(?:json)?\s*(.*?)\s*```"
NUMBER = (
    r"(?i)^[+-]?(inf|infinity|(\d+(_\d+)*)(\.(\d+(_\d+)*)?)?(e[+-]?\d+)?|\.\d+(_\d+)*(e[+-]?\d+)?)$"
)


def unfenced(raw: Column) -> Column:
    """The text inside a code fence, or the text itself without one."""
    inside = F.regexp_extract(raw, FENCE, 1)
    return F.when(inside != "", inside).otherwise(raw)


def parsed(raw: Column) -> Column:
    """The answer as a variant; null when it is no JSON."""
    return F.try_parse_json(unfenced(raw))


def fields_of(answer: Column) -> Column:
    """The top-level fields of an answer; null when it is no JSON object."""
    return F.try_variant_get(answer, "$", "map<string,variant>")


def repaired_category(category: Column) -> Column:
    """Exact name, else the first category named inside the text, else the default."""
    lowered = F.lower(category)
    rescued = [F.when(F.contains(lowered, F.lit(name.lower())), F.lit(name)) for name in CATEGORIES]
    return F.coalesce(F.when(category.isin(CATEGORIES), category), *rescued, F.lit(DEFAULT_CATEGORY))


def number_or_null(text: Column) -> Column:
    """A number written as text; null for anything else."""
    stripped = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    plain = F.when(F.lower(stripped) == "true", "1").when(F.lower(stripped) == "false", "0").otherwise(
        F.when(F.rlike(stripped, F.lit(NUMBER)), F.regexp_replace(stripped, "_", ""))
    )
    return plain.try_cast("double")


def answer_fields(fields: Column) -> dict[str, Column]:
    """Columns of one answer (see `fields_of`); `usable` says whether they may be used.

    A missing confidence counts as the default; an explicit null or a text
    that is no number makes the whole answer unusable.
    """

    def field(name: str, kind: str) -> Column:
        return F.try_variant_get(fields[name], "$", kind)

    confidence = F.when(
        F.map_contains_key(fields, "confidence"), number_or_null(field("confidence", "string"))
    ).otherwise(F.lit(ANSWER_DEFAULT_CONFIDENCE))
    return {
        "usable": F.coalesce(fields.isNotNull() & clamped(confidence).isNotNull(), F.lit(False)),
        "category": repaired_category(F.coalesce(field("category", "string"), F.lit(""))),
        "confidence": clamped(confidence),
        "reasoning": field("reasoning", "string"),
        "key_indicators": F.coalesce(
            field("key_indicators", "array<string>"), F.array().cast("array<string>")
        ),
    }
