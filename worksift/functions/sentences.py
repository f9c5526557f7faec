"""Rendering of the sentence that explains a fired flag."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Templates by flag variant, category phrases and length limits.
TEMPLATES = {
    "default": "Cost is {multiple}x the median for {category} works in this state.",
    "no_multiple": "Cost is above the usual range for {category} works here.",
    "zero_spend": "Sanctioned {months} months ago, zero expenditure recorded.",
    "part_spend": "Sanctioned {months} months ago, {percent_spent} percent spent.",
    "no_update": "No expenditure update in {months} months.",
    "over_sanction": "Expenditure is {percent_over} percent above sanction.",
    "full_spend_open": "Full amount spent, work still under implementation.",
    "mps": "Agency holds works from {mp_count} different MPs.",
    "districts_and_mps": "Agency holds works in {district_count} districts, {mp_count} MPs.",
    "vendor": "Vendor appears in {district_count} districts this year.",
}
CATEGORY_PHRASES = {
    "Road": "road",
    "Drinking Water": "drinking water",
    "School": "school building",
    "Health": "health centre",
}
MAX_LENGTH = {
    "multiple": 5,
    "category": 14,
    "months": 3,
    "percent_spent": 3,
    "percent_over": 4,
    "mp_count": 3,
    "district_count": 3,
}


def category_phrase(category: Column) -> Column:
    """Lower-case phrase, cut at the last whole word that fits."""
    limit = MAX_LENGTH["category"]
    chain = F
    for name, phrase in CATEGORY_PHRASES.items():
        chain = chain.when(category == name, phrase)
    phrase = chain.otherwise(F.lower(category))
    head = F.substring(phrase, 1, limit)
    cut = F.when(head.contains(" "), F.regexp_replace(head, " [^ ]*$", "")).otherwise(head)
    return F.when(F.length(phrase) <= limit, phrase).otherwise(cut)


def _clamped(text: Column, limit: int) -> Column:
    """A number too long for its place reads as the largest that fits."""
    nines = F.when(text.startswith("-"), F.lit("-" + "9" * max(1, limit - 1))).otherwise(
        F.lit("9" * limit)
    )
    return F.when(F.length(text) > limit, nines).otherwise(text)


def _value_text(name: str, c: Column) -> Column:
    if name == "category":
        return category_phrase(c)
    if name == "multiple":
        text = F.when(c >= 100, F.format_string("%.0f", F.bround(c, 0))).otherwise(
            F.format_string("%.1f", F.bround(c, 1))
        )
    else:
        text = F.bround(c.cast("double"), 0).cast("bigint").cast("string")
    return _clamped(text, MAX_LENGTH[name])


def sentence(variant: Column, values: dict[str, Column]) -> Column:
    """The template of ``variant`` with its places filled from ``values``; null for no variant."""
    chain = F
    for name, template in TEMPLATES.items():
        used = [k for k in values if "{" + k + "}" in template]
        if template.count("{") != len(used):
            continue
        text = F.lit(template)
        for k in used:
            text = F.replace(text, F.lit("{" + k + "}"), _value_text(k, values[k]))
        chain = chain.when(variant == name, text)
    return chain.otherwise(None)
