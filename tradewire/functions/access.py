"""Addressing within a segment, an element and a message.

A segment is a struct with ``tag`` and ``elements``; an element a struct with ``components``. Of a
message, ``segments`` is the array of its segments in order. Indices count from zero; what is
absent is null, and ``required_*`` pair the value with an error struct.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tradewire.errors import error, no_error
from tradewire.functions.syntax import glob


def element(seg: Column, n: int) -> Column:
    return F.get(seg["elements"], F.lit(n))


def components(seg: Column, n: int) -> Column:
    """All components of an element; an empty array where it is absent."""
    return F.coalesce(element(seg, n)["components"], F.array().cast("array<string>"))


def component(seg: Column, n: int, c: int = 0) -> Column:
    return F.get(element(seg, n)["components"], F.lit(c))


def component_or_empty(seg: Column, n: int, c: int = 0) -> Column:
    return F.coalesce(component(seg, n, c), F.lit(""))


element_str = component_or_empty


def element_span(seg: Column, n: int) -> Column:
    return element(seg, n)["span"]


def component_span(seg: Column, n: int, c: int = 0) -> Column:
    return F.get(element(seg, n)["component_spans"], F.lit(c))


def optional(seg: Column, n: int, c: int = 0) -> Column:
    """The value, or null where absent or empty."""
    return F.nullif(component(seg, n, c), F.lit(""))


def required_element(seg: Column, n: int) -> Column:
    """Struct of value and error (E008 where absent or empty)."""
    v = optional(seg, n)
    return F.struct(v.alias("value"), F.when(v.isNull(), error("E008", tag=seg["tag"], element_index=n)).otherwise(no_error()).alias("error"))


def required_component(seg: Column, n: int, c: int) -> Column:
    """Struct of value and error: E008 without the element, E021 without the component."""
    v = optional(seg, n, c)
    wrong = F.when(element(seg, n).isNull(), error("E008", tag=seg["tag"], element_index=n)).when(v.isNull(), error("E021", tag=seg["tag"], element_index=n, component_index=c))
    return F.struct(v.alias("value"), wrong.otherwise(no_error()).alias("error"))


def code_element(seg: Column, n: int, kind: str, offset: Column | None = None) -> Column:
    """Struct of the parsed value and error: E008 where absent, E003 (at ``offset``) where it is no ``kind``."""
    v = optional(seg, n)
    parsed = v.try_cast(kind)
    at = F.lit(0).cast("long") if offset is None else offset
    wrong = F.when(v.isNull(), error("E008", tag=seg["tag"], element_index=n)).when(parsed.isNull(), error("E003", offset=at, tag=seg["tag"], element_index=n))
    return F.struct(parsed.alias("value"), wrong.otherwise(no_error()).alias("error"))


def repeating_components(seg: Column, n: int, start: int, count: int) -> Column:
    """Struct of ``count`` components from ``start`` and the first error among them."""
    each = [required_component(seg, n, start + i) for i in range(count)]
    values = F.array(*[e["value"] for e in each]) if each else F.array().cast("array<string>")
    return F.struct(values.alias("value"), (F.coalesce(*[e["error"] for e in each]) if each else no_error()).alias("error"))


def segment_matches(seg: Column, tag: str, qualifier: str | None = None) -> Column:
    """Tag and, where given, element 0 against the pattern (an absent element is the empty text)."""
    same = seg["tag"] == tag
    return same if qualifier is None else same & glob(component_or_empty(seg, 0), qualifier)


def find_all(segments: Column, tag: str, qualifier: str | None = None) -> Column:
    return F.filter(segments, lambda s: segment_matches(s, tag, qualifier))


def find_first(segments: Column, tag: str, qualifier: str | None = None) -> Column:
    return F.get(find_all(segments, tag, qualifier), F.lit(0))


def any_match(segments: Column, tag: str, qualifier: str | None = None) -> Column:
    return F.exists(segments, lambda s: segment_matches(s, tag, qualifier))


def map_all(segments: Column, tag: str, to: Callable[[Column], Column], qualifier: str | None = None) -> Column:
    return F.transform(find_all(segments, tag, qualifier), to)


def trimmed_size(parts: Column) -> Column:
    """Number of components without the empty ones at the end."""
    return F.aggregate(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(F.lit(0))), F.lit(0), lambda a, x: F.greatest(a, x))
