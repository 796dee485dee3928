"""Localised text: coalescing under a language priority, and tag maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The priority where none is given; an empty one matches nothing.
UNDETERMINED = ("und",)


def label(tags: Column, locale: Sequence[str] | None, many: bool = False) -> Column:
    """The text (or, with `many`, the texts) under the first tag of the priority that is present; tags match exactly."""
    locale = UNDETERMINED if locale is None else locale
    if not locale:
        return F.lit(None).cast("array<string>" if many else "string")
    return F.coalesce(*(tags[t] for t in locale))


def in_ranges(tags: Column, ranges: Sequence[str]) -> Column:
    """The entries whose tags lie in one of the basic language ranges: equal, or longer by whole subtags."""
    if "*" in ranges:
        return tags

    def within(tag: Column, _: Column) -> Column:
        own, found = F.lower(tag), F.lit(False)
        for r in ranges:
            found = found | (own == r.lower()) | own.startswith(r.lower() + "-")
        return found

    return F.map_filter(tags, within)


def has_tokens(text: Column, search: str) -> Column:
    """Whether a text holds each word of a search somewhere, whatever the case (null or false if not, as for a filter)."""
    found = text.isNotNull()
    for token in search.split():
        found = found & F.contains(F.lower(text), F.lower(F.lit(token)))
    return found
