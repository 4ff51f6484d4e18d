"""Segments back to text, as Columns and as an ordered aggregation."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewire.functions.syntax import DEFAULT, ServiceChars, decimal_text, escape


def as_text(value: Column, kind: str | None = None, chars: ServiceChars = DEFAULT) -> Column:
    """One escaped component: null is empty, numbers without exponent, booleans as true or false.

    ``kind``: the value's type where it is known; else Spark's own, which is a constant of the plan.
    """
    if kind is None and not any(c.isdigit() or c == "-" for c in (chars.component, chars.element, chars.release, chars.terminator)):
        whole = F.typeof(value).rlike("^(tinyint|smallint|int|bigint)$")  # digits need no escape
        return F.when(whole, F.coalesce(value.cast("string"), F.lit(""))).otherwise(_escaped_text(value, kind, chars))
    return _escaped_text(value, kind, chars)


def _escaped_text(value: Column, kind: str | None, chars: ServiceChars) -> Column:
    if kind is None:
        plain = F.when(F.typeof(value).rlike("^(double|float|decimal)"), decimal_text(value)).otherwise(value.cast("string"))
    else:
        plain = decimal_text(value) if kind in ("double", "float") or kind.startswith("decimal") else value.cast("string")
    return escape(F.coalesce(plain, F.lit("")), chars)


def composite(parts: list[Column], chars: ServiceChars = DEFAULT) -> Column:
    return F.concat_ws(chars.component, *[as_text(p, chars=chars) for p in parts])


def segment_text(tag: Column | str, elements: list[Column | list[Column]], chars: ServiceChars = DEFAULT) -> Column:
    """A segment of a fixed shape; an element is one value or a list of components."""
    tag = tag if isinstance(tag, Column) else F.lit(tag)
    made = [composite(e, chars) if isinstance(e, list) else as_text(e, chars=chars) for e in elements]
    return F.concat(F.concat_ws(chars.element, tag, *made), F.lit(chars.terminator))


def elements_text(elements: Column, chars: ServiceChars = DEFAULT) -> Column:
    """The elements of a parsed segment, each after its separator."""
    one = lambda e: F.concat(F.lit(chars.element), F.array_join(F.transform(e["components"], lambda c: escape(c, chars)), chars.component))
    return F.array_join(F.transform(elements, one), "")


def parsed_text(seg: Column, chars: ServiceChars = DEFAULT) -> Column:
    return F.concat(seg["tag"], elements_text(seg["elements"], chars), F.lit(chars.terminator))


def raw_segment(tag: str, elements: Column, chars: ServiceChars = DEFAULT) -> Column:
    """A segment of raw texts, each cut at every component separator before it is escaped."""
    cut = lambda e: F.array_join(F.transform(F.split(e, "\\" + chars.component, -1), lambda p: escape(p, chars)), chars.component)
    return F.concat(F.lit(tag), F.array_join(F.transform(elements, lambda e: F.concat(F.lit(chars.element), cut(e))), ""), F.lit(chars.terminator))


def segments_text(segments: Column, chars: ServiceChars = DEFAULT, una: bool = False) -> Column:
    """A whole array of segments; ``una`` puts the header before them."""
    body = F.array_join(F.transform(segments, lambda s: parsed_text(s, chars)), "")
    return F.concat(F.lit(chars.una()), body) if una else body


def write_text(segments: DataFrame, key: str = "interchange_id", chars: ServiceChars = DEFAULT, una: bool = False) -> DataFrame:
    """(key, content, n_segments) from exploded segments, in order of ``seq``."""
    line = F.concat("tag", elements_text(F.col("elements"), chars), F.lit(chars.terminator))
    rows = segments.select(key, "seq", line.alias("line")).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "")
    return rows.select(key, (F.concat(F.lit(chars.una()), body) if una else body).alias("content"), F.size("lines").cast("long").alias("n_segments"))


def from_events(events: DataFrame, key: str = "interchange_id", chars: ServiceChars = DEFAULT) -> DataFrame:
    """(key, content) from an event stream (key, seq, pos, kind, value), whose places (seq, pos) differ within a key."""
    value = F.coalesce("value", F.lit(""))
    part = (
        F.when(F.col("kind") == "start_segment", value)
        .when(F.col("kind") == "element", F.concat(F.lit(chars.element), escape(value, chars)))
        .when(F.col("kind") == "component_element", F.concat(F.lit(chars.component), escape(value, chars)))
        .otherwise(F.lit(chars.terminator))
    )
    rows = _joined(events.select(key, "seq", "pos", "kind", part.alias("part")), key).groupBy(key).agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "part"))).alias("parts"))
    return rows.select(key, F.array_join(F.transform("parts", lambda x: x["part"]), "").alias("content"))


def _joined(parts: DataFrame, key: str) -> DataFrame:
    """(key, seq, pos, part) with neighbouring rows as one where nothing can stand between them.

    These are the next place of a segment, and the start of the next segment after the end of one. A stream in
    order is so grouped as whole texts and not as tokens; any other one as it is.
    """
    schema = T.StructType([parts.schema[n] for n in (key, "seq", "pos", "part")])
    if isinstance(parts.schema[key].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return parts.drop("kind")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, seq, pos, kind, part = batch.columns
            now, before = slice(1, None), slice(None, -1)
            number = lambda x: pc.fill_null(x, -9).to_numpy(zero_copy_only=False).astype(np.int64)
            same = pc.fill_null(pc.equal(keys[now], keys[before]), False).to_numpy(zero_copy_only=False)
            step, place = np.diff(number(seq)), number(pos)
            is_kind = lambda x, k: pc.fill_null(pc.equal(x, k), False).to_numpy(zero_copy_only=False)
            inside = (step == 0) & (np.diff(place) == 1)
            after = (step == 1) & (place[now] == 0) & is_kind(kind[now], "start_segment") & is_kind(kind[before], "end_segment")
            first = np.flatnonzero(np.concatenate(([True], ~(same & (inside | after)))))
            lists = pa.LargeListArray.from_arrays(pa.array(np.append(first, batch.num_rows), pa.int64()), part.cast(pa.large_string()))
            at = pa.array(first)
            text = pc.binary_join(lists, pa.scalar("", pa.large_string())).cast(part.type)
            yield pa.RecordBatch.from_arrays([keys.take(at), seq.take(at), pos.take(at), text], names=[key, "seq", "pos", "part"])

    return parts.mapInArrow(run, schema)
