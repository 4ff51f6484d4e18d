"""The error catalogue and Column builders for errors carried as data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codes, message templates and hints of the error catalogue.
# code: (name, template, hint or None)
CATALOGUE: dict[str, tuple[str, str, str | None]] = {
    "E001": ("UnexpectedEof", "unexpected end of input at byte offset {offset}", "Ensure every segment ends with the configured segment terminator"),
    "E002": ("InvalidDelimiter", "invalid delimiter byte 0x{byte} at offset {offset}", "Check UNA service string advice and delimiter bytes in the payload"),
    "E003": ("InvalidText", "invalid EDIFACT text at byte offset {offset}", "Input must be valid UTF-8 text for segment and element values"),
    "E004": ("MessageCountMismatch", "interchange message count mismatch: UNZ declared {expected}, found {actual}", None),
    "E005": ("SegmentCountMismatch", "segment count mismatch in message {message_ref}: UNT declared {expected}, found {actual}", None),
    "E006": ("InvalidSegmentTag", "invalid segment tag {tag}", "Segment tags must be 3 ASCII uppercase letters"),
    "E007": ("InvalidUna", "invalid UNA service string advice: must be exactly 9 bytes", "UNA must be exactly 9 bytes: 'UNA' followed by 6 service characters"),
    "E008": ("MissingRequiredElement", "missing required element {element_index} in segment {tag}", "Provide all mandatory elements for the segment per directory rules"),
    "E009": ("InvalidUtf8", "serialized output contains invalid UTF-8", None),
    "E010": ("Io", "{detail}", None),
    "E011": ("InvalidSegmentForMessage", "segment {tag} is not valid for message type {message_type}", "Remove unsupported segment or switch to the correct message type"),
    "E012": ("InvalidElementCount", "segment {tag} has {actual} elements, expected between {min} and {max}", "Adjust the segment element count to the allowed min/max range"),
    "E013": ("InvalidComponentCount", "segment {tag} element {element_index} has {actual} components, expected {expected}", "Fix composite element arity to match the expected component count"),
    "E014": ("InvalidCodeValue", "segment {tag} element {element_index}: '{value}' is not a valid code (code list {code_list})", "Use a value from the referenced code list for this element"),
    "E015": ("MissingSegment", "required segment {tag} is missing from message (position {expected_position})", "Insert the required segment at the expected position"),
    "E016": ("QualifierMismatch", "segment {tag} has qualifier '{actual}', expected '{expected}'", "Set the segment qualifier to the expected value"),
    "E017": ("ConditionalRequirementNotMet", "segment {tag} element {element_index}: conditional requirement not met ({condition})", "When the condition is met, include the conditionally required element"),
    "E018": ("ValidationFailed", "validation failed with {error_count} issue(s); first issue: {first_message}", None),
    "E019": ("InvalidReleaseSequence", "invalid release sequence at byte offset {offset}: dangling release character", "Release character must escape one following byte; trailing '?' is invalid"),
    "E020": ("SegmentTooLong", "segment starting at byte offset {offset} exceeded maximum length of {limit} bytes", "Increase max_segment_bytes in ReaderConfig or reject the input as malformed"),
    "E021": ("MissingRequiredComponent", "missing required component {component_index} in element {element_index} of segment {tag}", "Provide all mandatory components for the composite element per directory rules"),
}
WARNINGS = ("E014", "E016")
SEVERITIES = ("critical", "error", "warning", "info")

ERROR = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("offset", T.LongType()),
        T.StructField("tag", T.StringType()),
        T.StructField("element_index", T.IntegerType()),
        T.StructField("component_index", T.IntegerType()),
    ]
)


class EdiError(Exception):
    """Raised on the driver only: strict validation, fail-fast reading, empty extraction."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code, self.message = code, message


def hint(code: str) -> str | None:
    return CATALOGUE[code][2]


def severity(code: str) -> str:
    return "warning" if code in WARNINGS else "error"


def text(code: str, **values: object) -> str:
    return CATALOGUE[code][1].format(**values)


def message(code: str, **values: Column | str | int) -> Column:
    """The message template filled with values and Columns; a null Column is the empty text."""
    form, columns, rest = "", [], CATALOGUE[code][1]
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        form += before.replace("%", "%%")
        if isinstance(values[name], Column):
            form += "%s"
            columns.append(F.coalesce(values[name].cast("string"), F.lit("")))
        else:
            form += str(values[name]).replace("%", "%%")
    form += rest.replace("%", "%%")
    return F.format_string(form, *columns) if columns else F.lit(form.replace("%%", "%"))


_DDL = "struct<code:string,message:string,offset:bigint,tag:string,element_index:int,component_index:int>"


def error(code: str, *, offset: Column | int | None = None, tag: Column | str | None = None, element_index: Column | int | None = None, component_index: Column | int | None = None, **values: Column | str | int) -> Column:
    """An error struct; the location fields also fill the message template."""
    own = {"offset": offset, "tag": tag, "element_index": element_index, "component_index": component_index}
    filled = values | {k: v for k, v in own.items() if v is not None}
    fields = [v if isinstance(v, Column) else F.lit(v) for v in own.values()]
    return F.struct(F.lit(code), message(code, **filled), *fields).cast(_DDL)


def no_error() -> Column:
    return F.lit(None).cast(_DDL)
