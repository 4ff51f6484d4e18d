"""Layered validation: directory structure, code lists and rule packs, all giving one table of issues.

Input is a row for each message with ``segments`` (and ``message_no``, ``message_type``), from
``windows.messages`` or, for one message a text, from ``parse`` through ``as_messages``. Nothing is
shuffled: every check is an expression over the message's array, and dictionaries are maps of a
size checked when the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tradewire.errors import EdiError, error, hint, no_error, severity, text
from tradewire.functions.access import trimmed_size
from tradewire.operators.parse import exploded

ISSUE = T.StructType(
    [
        T.StructField("severity", T.StringType()),
        T.StructField("error_code", T.StringType()),
        T.StructField("rule_id", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("segment_tag", T.StringType()),
        T.StructField("element_index", T.IntegerType()),
        T.StructField("component_index", T.IntegerType()),
        T.StructField("offset", T.LongType()),
        T.StructField("suggestion", T.StringType()),
    ]
)
MOST_SEGMENT_TYPES, MOST_CODES = 5_000, 200_000

# Tags whose component (0, 0) is checked against a code list, and required segments.
BASE_CODE_RULES = {"BGM": "1001", "DTM": "2005", "NAD": "3035", "QTY": "6063", "RFF": "1153", "MOA": "5025", "PRI": "5125", "LOC": "3227"}
REQUIRED_SEGMENTS = {"UTILMD": ("UNH", "BGM", "UNT"), "ORDERS": ("UNH", "BGM", "UNT"), "INVOIC": ("UNH", "BGM", "UNT")}
REQUIRED_OTHERWISE = ("UNH", "UNT")
ADD_HINT = "Add the mandatory segment at the correct position"
ORDER_HINT = "Ensure required segments follow UN/EDIFACT canonical order"


_DDL = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in ISSUE.fields) + ">"


def issue(severity: str | Column, message: str | Column, **fields: object) -> Column:
    """An issue struct; fields are those of ISSUE, each a value or a Column. Indices stop at 255."""
    given = {"severity": severity, "message": message} | fields
    unknown = set(given) - set(ISSUE.names)
    if unknown:
        raise ValueError(f"no such fields of an issue: {sorted(unknown)}")
    out = []
    for f in ISSUE.fields:
        v = given.get(f.name)
        if f.name in ("element_index", "component_index") and v is not None:
            v = F.when(v > 255, 255).otherwise(v) if isinstance(v, Column) else min(v, 255)
        out.append(v if isinstance(v, Column) else F.lit(v))
    return F.struct(*out).cast(_DDL)


def issue_of(err: Column, suggestion: Column | None = None) -> Column:
    """The issue of an error struct: its code's severity, location and default hint."""
    levels = F.create_map(*[x for c in _codes() for x in (F.lit(c), F.lit(severity(c)))])
    hints = F.create_map(*[x for c in _codes() if hint(c) for x in (F.lit(c), F.lit(hint(c)))])
    own = hints[err["code"]]
    own = own if suggestion is None else F.coalesce(suggestion, own)
    bare = err["code"].isin("E004", "E005", "E006", "E007", "E020")
    offset = F.when(~bare, err["offset"])
    return issue(levels[err["code"]], err["message"], error_code=err["code"], segment_tag=F.when(~bare, err["tag"]), element_index=err["element_index"], component_index=err["component_index"], offset=offset, suggestion=own)


def _codes() -> list[str]:
    from tradewire.errors import CATALOGUE

    return list(CATALOGUE)


CodeRule = str | tuple[tuple[int, int, str], ...]


def places(rule: CodeRule) -> tuple[tuple[int, int, str], ...]:
    """(element, component, data element) of each checked place; a name alone stands for place (0, 0)."""
    return ((0, 0, rule),) if isinstance(rule, str) else tuple(rule)


def code_table_issues(messages: DataFrame, codes: DataFrame, rules: dict[str, CodeRule] = BASE_CODE_RULES, suggestions: DataFrame | None = None) -> DataFrame:
    """Issues of code lists that are tables of any size: the messages' other columns and the fields of ISSUE.

    codes: (data_element, code); suggestions: (data_element, code, suggestion). A data element without
    codes is not checked. Values are joined with the table, one row for each value checked.
    """
    spans = "span" in messages.schema["segments"].dataType.elementType.names
    keep = [c for c in messages.columns if c not in ("segments", "error")]
    # One row a place, tag and all: the rules are few and stand in the plan.
    every = [(tag, *p) for tag, rule in rules.items() for p in places(rule)]

    def of(seg: Column) -> Column:
        found = [F.when(seg["tag"] == tag, F.struct(F.lit(e).alias("element"), F.lit(name).alias("data_element"), F.get(F.get(seg["elements"], F.lit(e))["components"], F.lit(c)).alias("value"), seg["tag"].alias("tag"), (seg["span"]["start"] if spans else F.lit(None).cast("long")).alias("at"))) for tag, e, c, name in every]
        return F.filter(F.array(*found), lambda x: F.coalesce(x["value"], F.lit("")) != "")

    checked = exploded(messages, F.struct(*keep).alias("row"), of=F.flatten(F.transform("segments", of)), name="x").select("row", "x.*")
    listed = codes.select("data_element").distinct()
    unknown = checked.join(listed, "data_element", "left_semi").join(codes.select("data_element", F.col("code").alias("value")), ["data_element", "value"], "left_anti")
    hints = suggestions.select("data_element", F.col("code").alias("value"), "suggestion") if suggestions is not None else None
    unknown = unknown.withColumn("suggestion", F.lit(None).cast("string")) if hints is None else unknown.join(hints, ["data_element", "value"], "left")
    err = error("E014", tag=F.col("tag"), element_index=F.col("element"), value=F.col("value"), code_list=F.col("data_element"), offset=F.col("at"))
    return unknown.withColumn("err", err).select("row.*", issue_of(F.col("err"), F.col("suggestion")).alias("issue")).select(*keep, "issue.*")


@dataclass(frozen=True)
class ElementRef:
    """position counts from one."""

    position: int
    mandatory: bool = False
    data_element: str = ""
    max_repeat: int = 1


@dataclass(frozen=True)
class SegmentDefinition:
    tag: str
    elements: tuple[ElementRef, ...] = ()
    name: str = ""
    components: dict[int, int] = field(default_factory=dict)  # element index -> expected components


@dataclass(frozen=True)
class DirectoryValidator:
    """Checks against a segment dictionary and code lists; the first failure of a segment counts."""

    directory_id: str = "D"
    definitions: tuple[SegmentDefinition, ...] = ()
    codes: dict[str, tuple[str, ...]] = field(default_factory=dict)  # data element -> valid codes
    suggestions: dict[str, str | dict[str, str]] = field(default_factory=dict)  # data element -> hint, or value -> hint
    code_rules: dict[str, CodeRule] = field(default_factory=lambda: dict(BASE_CODE_RULES))
    extra_rule: Callable[[Column], Column] | None = None  # segment -> error struct or null
    structure: bool = True
    code_list: bool = True
    known_tags: bool = False
    message_type: str | None = None

    def __post_init__(self) -> None:
        if len(self.definitions) > MOST_SEGMENT_TYPES or sum(map(len, self.codes.values())) > MOST_CODES:
            raise ValueError("a directory of this size belongs in a table: see code_table_issues")

    def structure_only(self) -> DirectoryValidator:
        return replace(self, structure=True, code_list=False)

    def code_list_only(self) -> DirectoryValidator:
        return replace(self, structure=False, code_list=True)

    def with_code_list_rules(self, rules: dict[str, CodeRule]) -> DirectoryValidator:
        return replace(self, code_rules=dict(rules))

    def enforce_known_tags(self, on: bool = True) -> DirectoryValidator:
        return replace(self, known_tags=on)

    def with_message_type(self, message_type: str | None) -> DirectoryValidator:
        return replace(self, message_type=message_type)

    def segment_error(self, seg: Column, spans: bool) -> Column:
        """The first failure of a segment, or null."""
        start = seg["span"]["start"] if spans else F.lit(None).cast("long")
        n = F.size(seg["elements"])
        kinds = []
        for d in self.definitions:
            checks = []
            least = max((i + 1 for i, e in enumerate(d.elements) if e.mandatory), default=0)
            most = len(d.elements)
            if self.structure:
                checks.append(F.when((n < least) | (n > most), error("E012", tag=d.tag, min=least, max=most, actual=n, offset=start)))
                for e in d.elements:
                    if e.mandatory:
                        at = max(e.position - 1, 0)
                        there = F.exists(F.coalesce(F.get(seg["elements"], F.lit(at))["components"], F.array().cast("array<string>")), lambda c: c != "")
                        checks.append(F.when(~there, error("E008", tag=d.tag, element_index=at)))
                for at, expected in sorted(d.components.items()):
                    parts = F.get(seg["elements"], F.lit(at))["components"]
                    size = trimmed_size(parts)
                    checks.append(F.when(parts.isNotNull() & (size != expected), error("E013", tag=d.tag, element_index=at, actual=size, expected=expected, offset=start)))
                if self.extra_rule is not None:
                    checks.append(self.extra_rule(seg))
            if self.code_list:
                for element, component, name in places(self.code_rules.get(d.tag, ())):
                    value = F.get(F.get(seg["elements"], F.lit(element))["components"], F.lit(component))
                    if name in self.codes:
                        checks.append(F.when((value != "") & ~value.isin(*self.codes[name]), error("E014", tag=d.tag, element_index=element, value=value, code_list=name, offset=start)))
            if checks:
                kinds.append((d.tag, F.coalesce(*checks)))
        out = None
        for tag, check in kinds:
            out = F.when(seg["tag"] == tag, check) if out is None else out.when(seg["tag"] == tag, check)
        if self.structure and self.known_tags:
            known = [d.tag for d in self.definitions]
            unknown = ~seg["tag"].isin(*known) if known else F.lit(True)
            own = error("E011", tag=seg["tag"], message_type=self.message_type or self.directory_id, offset=seg["tag_span"]["start"] if spans else None)
            out = F.when(unknown, own) if out is None else out.when(unknown, own)
        return no_error() if out is None else out.otherwise(no_error())

    def _suggestion(self, err: Column) -> Column | None:
        """The hint of a code's data element, or of the value itself, which the error's message quotes."""
        out = None
        for name, own in self.suggestions.items():
            mine = (err["code"] == "E014") & err["message"].endswith(f"(code list {name})")
            if isinstance(own, str):
                hint_ = F.lit(own)
            else:
                hint_ = F.create_map(*[F.lit(x) for pair in own.items() for x in pair])[F.regexp_extract(err["message"], r"(?s): '(.*)' is not a valid code ", 1)]
            out = F.when(mine, hint_) if out is None else out.when(mine, hint_)
        return out

    def issues(self, segments: Column, message_type: Column, spans: bool) -> Column:
        """Array of issues of a message: segments in order, then what is missing, then what is out of order."""
        # Each segment's error is worked out once; what follows reads the struct.
        errs = F.filter(F.transform(segments, lambda s: self.segment_error(s, spans)), lambda e: e.isNotNull())
        parts = [F.transform(errs, lambda e: issue_of(e, self._suggestion(e)))]
        if self.structure:
            kind = F.lit(self.message_type) if self.message_type is not None else message_type
            tags = F.transform(segments, lambda s: s["tag"])
            at = lambda t: F.array_position(tags, t)  # noqa: E731  from one; 0: absent
            missing, order = [], []
            groups: dict[tuple[str, ...], list[str]] = {}
            for name, needed in REQUIRED_SEGMENTS.items():
                groups.setdefault(needed, []).append(name)
            listed = [n for names in groups.values() for n in names]
            for needed, names in [*groups.items(), (REQUIRED_OTHERWISE, None)]:
                scope = kind.isNotNull() & (kind.isin(*names) if names else ~kind.isin(*listed))
                for tag in needed:
                    words = F.concat(F.lit(f"required segment {tag} missing for message type "), kind)
                    missing.append(F.when(scope & (at(tag) == 0), issue("error", words, segment_tag=tag, suggestion=ADD_HINT)))
                for i, tag in enumerate(needed[1:], 1):
                    before = F.coalesce(*[F.when(at(t) > 0, at(t)) for t in reversed(needed[:i])])
                    words = F.concat(F.lit("segment sequence violation for message type "), kind, F.lit(f": '{tag}' appears out of order"))
                    order.append(F.when(scope & (at(tag) > 0) & (at(tag) < before), issue("error", words, segment_tag=tag, suggestion=ORDER_HINT)))
            parts += [F.filter(F.array(*missing), lambda x: x.isNotNull()), F.filter(F.array(*order), lambda x: x.isNotNull())]
        return F.concat(*parts)


Rule = Callable[[Column], Column]


@dataclass(frozen=True)
class RulePack:
    """Rules over a message's segments array, each giving an issue or null; scoped by message types (none: all)."""

    name: str
    message_types: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()

    def for_message_type(self, message_type: str) -> RulePack:
        return replace(self, message_types=tuple(dict.fromkeys((*self.message_types, message_type))))

    def with_rule(self, rule: Rule) -> RulePack:
        return replace(self, rules=(*self.rules, rule))

    def merge(self, other: RulePack) -> RulePack:
        """Types of both, without repeats, and all rules; merging widens the scope of either's rules."""
        return replace(self, message_types=tuple(dict.fromkeys((*self.message_types, *other.message_types))), rules=(*self.rules, *other.rules))

    @property
    def rule_count(self) -> int:
        return len(self.rules)

    def issues(self, segments: Column, message_type: Column, spans: bool) -> Column:
        if not self.rules:
            return F.array().cast(f"array<{_DDL}>")
        found = F.filter(F.array(*[r(segments) for r in self.rules]), lambda x: x.isNotNull())
        if not self.message_types:
            return found
        return F.when(F.coalesce(message_type.isin(*self.message_types), F.lit(False)), found).otherwise(F.array().cast(f"array<{_DDL}>"))


LAYERS = ("structure", "code_list", "profile")


def _in_layer(issues: Column, layer: str) -> Column:
    return F.transform(issues, lambda i: F.struct(F.lit(layer).alias("layer"), i.alias("issue")))


@dataclass(frozen=True)
class ValidationContext:
    """Validators in the order they were added, each in a layer that can be switched off."""

    message_type: str | None = None
    validators: tuple[tuple[str, object], ...] = ()
    layers: frozenset[str] = frozenset(LAYERS)

    def with_message_type(self, message_type: str) -> ValidationContext:
        return replace(self, message_type=message_type)

    def with_layer(self, layer: str, on: bool) -> ValidationContext:
        if layer not in LAYERS:
            raise ValueError(f"no such layer: {layer}")
        return replace(self, layers=self.layers | {layer} if on else self.layers - {layer})

    def with_validator(self, layer: str, validator: object) -> ValidationContext:
        if layer not in LAYERS:
            raise ValueError(f"no such layer: {layer}")
        return replace(self, validators=(*self.validators, (layer, validator)))

    def with_pack(self, pack: RulePack) -> ValidationContext:
        return self.with_validator("profile", pack)

    def validate(self, messages: DataFrame) -> DataFrame:
        """Issues of all messages: their other columns, layer, ordinal and the fields of ISSUE."""
        spans = "span" in messages.schema["segments"].dataType.elementType.names
        keep = [c for c in messages.columns if c not in ("segments", "error")]
        parts = []
        for layer, v in self.validators:
            if layer not in self.layers:
                continue
            own = v.with_message_type(self.message_type) if isinstance(v, DirectoryValidator) else v
            kind = F.get(F.get(F.get(F.filter("segments", lambda s: s["tag"] == "UNH"), F.lit(0))["elements"], F.lit(1))["components"], F.lit(0))
            got = own.issues(F.col("segments"), F.nullif(kind, F.lit("")), spans) if hasattr(own, "issues") else own(F.col("segments"))
            parts.append(_in_layer(got, layer))
        if not parts:
            parts = [F.array().cast(T.ArrayType(T.StructType([T.StructField("layer", T.StringType()), T.StructField("issue", ISSUE)])))]
        rows = messages.select(*keep, F.posexplode_outer(F.concat(*parts)).alias("ordinal", "__x")).where(F.col("ordinal").isNotNull())  # see exploded
        return rows.select(*keep, "ordinal", "__x.layer", "__x.issue.*")

    def validate_strict(self, messages: DataFrame) -> DataFrame:
        """The issues, if none is an error; else E018 (one action on the driver)."""
        found = self.validate(messages)
        wrong = found.where(F.col("severity").isin("critical", "error"))
        n = wrong.count()
        if n:
            first = wrong.orderBy(*[c for c in ("interchange_id", "message_no") if c in wrong.columns], "ordinal").select("message").first()[0]
            raise EdiError("E018", text("E018", error_count=n, first_message=first))
        return found


def as_messages(parsed: DataFrame, key: str = "interchange_id") -> DataFrame:
    """Rows of ``parse`` taken as one message each."""
    from tradewire.operators.windows import with_heads

    return with_heads(parsed.select(key, F.lit(0).alias("message_no"), "segments"))


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
