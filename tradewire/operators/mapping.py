"""Typed mapping between segments and structs, from declarations compiled to Columns.

A ``Segment`` names a tag, a qualifier and fields; a ``Message`` names segments by role. Mistakes
in a declaration raise ValueError when it is made, before any job.
"""

from __future__ import annotations

from dataclasses import dataclass
from dataclasses import field as _field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewire.errors import EdiError, error, no_error, text
from tradewire.functions.access import components, element, find_all, find_first, optional, segment_matches
from tradewire.functions.syntax import DEFAULT, ServiceChars
from tradewire.operators.writer import as_text

_TYPES = ("string", "int", "long", "double", "boolean", "date")


@dataclass(frozen=True)
class Field:
    """A value at (element, component), or a whole composite. ``element`` defaults to the field's place."""

    name: str
    element: int | None = None
    component: int | None = None
    type: str = "string"
    required: bool = False
    composite: bool = False

    def __post_init__(self) -> None:
        if not self.name.isidentifier():
            raise ValueError(f"field name {self.name!r} is not an identifier")
        if self.composite and self.component is not None:
            raise ValueError(f"field {self.name}: composite and component exclude each other")
        if self.composite and self.type != "string":
            raise ValueError(f"field {self.name}: a composite holds strings")
        if self.type not in _TYPES and not self.type.startswith("decimal"):
            raise ValueError(f"field {self.name}: unknown type {self.type!r}")
        if min(self.element or 0, self.component or 0) < 0:
            raise ValueError(f"field {self.name}: positions count from zero")


@dataclass(frozen=True)
class Segment:
    """tag, an optional qualifier (a glob over element 0) or ``qualifier_from`` (element 0 must not be empty)."""

    tag: str
    fields: tuple[Field, ...] = ()
    qualifier: str | None = None
    qualifier_from: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "fields", tuple(self.fields))
        if not (len(self.tag) == 3 and self.tag.isascii() and self.tag.isupper() and self.tag.isalpha()):
            raise ValueError(f"tag {self.tag!r} must be three capital letters")
        if self.qualifier is not None and self.qualifier_from is not None:
            raise ValueError("qualifier and qualifier_from exclude each other")
        names = [f.name for f in self.fields]
        if len(set(names)) != len(names):
            raise ValueError("two fields have one name")
        if self.qualifier_from is not None and self.qualifier_from not in names:
            raise ValueError(f"qualifier_from names no field: {self.qualifier_from}")
        taken = [(self.place(i), f.component or 0, f.composite) for i, f in enumerate(self.fields)]
        whole = {e for e, _, c in taken if c}
        if len(set(taken)) != len(taken) or any(e in whole and not c for e, _, c in taken):
            raise ValueError("two fields share a position")

    def place(self, i: int) -> int:
        f = self.fields[i]
        if f.element is not None:
            return f.element
        return i + (1 if self.qualifier is not None else 0)

    def matches(self, seg: Column) -> Column:
        return segment_matches(seg, self.tag, self.qualifier)

    def read(self, seg: Column) -> Column:
        """Struct of the fields and ``error``, the first that applies."""
        out, wrong = [], []
        if self.qualifier is not None:
            wrong.append(F.when(~self.matches(seg), error("E008", tag=self.tag, element_index=0)))
        elif self.qualifier_from is not None:
            wrong.append(F.when(optional(seg, 0).isNull(), error("E008", tag=self.tag, element_index=0)))
        for i, f in enumerate(self.fields):
            at = self.place(i)
            if f.composite:
                value = components(seg, at) if f.required else element(seg, at)["components"]
                missing = F.size(components(seg, at)) == 0
            else:
                held = optional(seg, at, f.component or 0)
                value = held if f.type == "string" else F.to_date(held, "yyyyMMdd") if f.type == "date" else held.try_cast(f.type)
                missing = held.isNull()
                if f.type != "string":
                    wrong.append(F.when(held.isNotNull() & value.isNull(), error("E003", tag=self.tag, offset=0, element_index=at)))
            out.append(value.alias(f.name))
            if f.required:
                wrong.append(F.when(missing, error("E008", tag=self.tag, element_index=at)))
        return F.struct(*out, (F.coalesce(*wrong, no_error()) if wrong else no_error()).alias("error"))

    def writer(self, chars: ServiceChars = DEFAULT):
        """A function of one struct, for ``transform``."""
        return lambda value: self.write(value, chars)

    def write(self, value: Column, chars: ServiceChars = DEFAULT) -> Column:
        """The segment's text from a struct of the fields; slots without a field are empty."""
        slots: dict[int, dict[int, Column]] = {}
        if self.qualifier is not None and "*" not in self.qualifier:
            slots[0] = {0: F.lit(self.qualifier)}
        whole: dict[int, Column] = {}
        for i, f in enumerate(self.fields):
            v = value[f.name]
            if f.composite:
                parts = F.transform(F.coalesce(v, F.array().cast("array<string>")), lambda c: as_text(c, chars=chars))
                whole[self.place(i)] = F.array_join(parts, chars.component)
            else:
                plain = F.date_format(v, "yyyyMMdd") if f.type == "date" else v
                slots.setdefault(self.place(i), {})[f.component or 0] = as_text(plain, f.type, chars)
        made = []
        for e in range(max([*slots, *whole], default=-1) + 1):
            held = slots.get(e, {})
            made.append(whole[e] if e in whole else F.concat_ws(chars.component, *[held.get(c, F.lit("")) for c in range(max(held, default=0) + 1)]))
        return F.concat(F.concat_ws(chars.element, F.lit(self.tag), *made), F.lit(chars.terminator))


@dataclass(frozen=True)
class Part:
    """A segment's role in a message: ``many``, ``required`` or optional; ``qualifier`` narrows the segment's own."""

    name: str
    segment: Segment
    many: bool = False
    required: bool = False
    qualifier: str | None = None

    def __post_init__(self) -> None:
        if self.many and self.required:
            raise ValueError(f"part {self.name}: many and required exclude each other")
        if self.qualifier is not None and self.segment.qualifier is not None and self.qualifier != self.segment.qualifier:
            raise ValueError(f"part {self.name}: two qualifiers")


@dataclass(frozen=True)
class Message:
    parts: tuple[Part, ...] = _field(default_factory=tuple)

    def __post_init__(self) -> None:
        object.__setattr__(self, "parts", tuple(self.parts))
        names = [p.name for p in self.parts]
        if not names:
            raise ValueError("a message needs parts")
        if len(set(names)) != len(names):
            raise ValueError("two parts have one name")

    def find(self, segments: Column) -> dict[str, Column]:
        """The segment (or, for ``many``, the segments) of each part."""
        pick = lambda p: (find_all if p.many else find_first)(segments, p.segment.tag, p.qualifier or p.segment.qualifier)
        return {p.name: pick(p) for p in self.parts}

    def read(self, found: dict[str, Column]) -> list[Column]:
        """The parts as structs, from what ``find`` gave (best held in columns, as each is used many times)."""
        return [(F.transform(found[p.name], p.segment.read) if p.many else F.when(found[p.name].isNotNull(), p.segment.read(found[p.name]))).alias(p.name) for p in self.parts]

    def error(self) -> Column:
        """The first error over columns that ``read`` made."""
        wrong = []
        for p in self.parts:
            mine = F.col(p.name)
            if p.many:
                wrong.append(F.get(F.filter(mine, lambda m: m["error"].isNotNull()), F.lit(0))["error"])
                continue
            if p.required:
                wrong.append(F.when(mine.isNull(), error("E015", tag=p.segment.tag, expected_position=p.name)))
            wrong.append(mine["error"])
        return F.coalesce(*wrong, no_error()).alias("error")

    def write(self, value: Column, chars: ServiceChars = DEFAULT) -> Column:
        """The text of all parts in order; an absent optional part writes nothing."""
        texts = []
        for p in self.parts:
            held = value[p.name]
            if p.many:
                texts.append(F.array_join(F.transform(held, p.segment.writer(chars)), ""))
            else:
                texts.append(F.when(held.isNotNull(), p.segment.write(held, chars)).otherwise(F.lit("")))
        return F.concat(*[F.coalesce(t, F.lit("")) for t in texts])


def extract_all(segments: DataFrame, spec: Segment) -> DataFrame:
    """Every matching segment of exploded segments, mapped; the filter runs before the mapping."""
    keep = [c for c in segments.columns if c not in ("tag", "elements", "span", "tag_span")]
    seg = F.struct("tag", "elements")
    return segments.where(spec.matches(seg)).select(*keep, spec.read(seg).alias("value")).select(*keep, "value.*")


def extract_first(rows: DataFrame, spec: Segment, key: str = "interchange_id") -> DataFrame:
    """The first match of each key, by ``seq``; a key without one gets E015.

    ``rows``: what ``parse`` gave, of which one small row for each interchange is grouped, or exploded
    segments, which are all grouped.
    """
    if "segments" in rows.columns:
        found = rows.select(key, find_first(F.col("segments"), spec.tag, spec.qualifier).alias("__seg"))
    else:
        seg = F.struct("seq", "tag", "elements")
        found = rows.select(key, F.when(spec.matches(seg), seg).alias("__seg"))
    seg = F.col("__seg")
    found = found.select(key, seg["seq"].alias("seq"), F.when(seg.isNotNull(), spec.read(seg)).alias("value"))
    rows = found.groupBy(key).agg(F.min("seq").alias("seq"), F.min_by("value", "seq").alias("value"))
    names = [f.name for f in spec.fields]
    missing = F.when(F.col("seq").isNull(), error("E015", tag=spec.tag, expected_position="first match"))
    return rows.select(key, "seq", *[F.col(f"value.{n}") for n in names], F.coalesce(missing, F.col("value.error")).alias("error"))


def map_messages(messages: DataFrame, spec: Message) -> DataFrame:
    """A column for each part, and the first error, from rows with a ``segments`` array."""
    keep = [c for c in messages.columns if c not in ("segments", "error")]
    found = messages.select(*keep, *[c.alias(f"__{n}") for n, c in spec.find(F.col("segments")).items()])
    parts = found.select(*keep, *spec.read({p.name: F.col(f"__{p.name}") for p in spec.parts}))
    return parts.select("*", spec.error())


def first_or_raise(rows: DataFrame, tag: str):
    """The first row of an extraction; E015 if there is none (a driver-side action)."""
    row = rows.first()
    if row is None:
        raise EdiError("E015", text("E015", tag=tag, expected_position="first match"))
    return row
