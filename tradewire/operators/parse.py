"""Text to segments, in built-in expressions.

``parse`` keeps a row for each interchange with its segments as an array: no shuffle, however many
rows there are. ``explode_segments`` turns them into rows; ``tokens`` and ``events`` go on from
there. Errors are data: the first one of an interchange stands in ``error`` and, in the modes of a
reader, ends its segments.

A text without a release character is cut by ``split`` at every level; only the segments of other
texts that hold one are matched by regular expressions. The result passes a ``Generate`` of one row, below which
Catalyst pushes no predicate on it: filters and joins on segments and errors never evaluate the
parse again, while filters on the other columns still reach the scan.

Offsets and lengths count bytes of the input. A content that is not UTF-8 is read as ISO-8859-1, so
that a character is a byte, and its values are decoded at the end. With ``spans`` the
starts of the segments are running sums of their sizes, the one step without a built-in function:
the sizes alone pass through an Arrow UDF.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewire.errors import EdiError, error, no_error, text
from tradewire.functions.syntax import DEFAULT, ServiceChars, after_each, held, quoted, service_chars, service_valid, unescape, up_to_each

MAX_SEGMENT_BYTES = 65_536
BLANKS = " \t\r\n"
REST = 1 << 30


def free_names(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name one that no column of ``df`` has."""
    lead = "_"
    while any(c.lower().startswith(lead + n) for c in df.columns for n in names):
        lead += "_"
    return {n: lead + n for n in names}


ACTIVE = ("component", "element", "release", "terminator")


def _fields(chars: ServiceChars | Column) -> dict[str, Column | str]:
    """The active characters by name, and under ``quoted_`` and ``live_`` their patterns: worked out once a row where the text names them."""
    if not isinstance(chars, ServiceChars):
        return {f"{k}{n}": chars[f"{k}{n}"] for n in ACTIVE for k in ("", "quoted_", "live_") if k != "live_" or n != "release"}
    return _patterned({n: getattr(chars, n) for n in ACTIVE})


def _patterned(c: dict) -> dict:
    return c | {f"quoted_{n}": quoted(c[n]) for n in ACTIVE} | {f"live_{n}": after_each(c[n], c["release"]) for n in ("component", "element")} | {"live_terminator": up_to_each(c["terminator"], c["release"])}


def _lit(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _ltrim(x: Column) -> Column:
    return F.ltrim(x, F.lit(BLANKS))


def _element_texts(body: Column, c: dict, plain: bool) -> Column:
    """The element texts of a segment without its terminator; it still has the tag."""
    quick = F.slice(F.split(body, c["quoted_element"], -1), 2, REST)
    if plain:
        return quick
    slow = F.regexp_extract_all(F.substring(body, 4, REST), c["live_element"], F.lit(1))
    return F.when(body.contains(_lit(c["release"])), slow).otherwise(quick)


def _component_texts(element: Column, c: dict, plain: bool) -> Column:
    quick = F.split(element, c["quoted_component"], -1)
    if plain:
        return quick
    slow = F.regexp_extract_all(F.concat(_lit(c["component"]), element), c["live_component"], F.lit(1))
    return F.when(element.contains(_lit(c["release"])), slow).otherwise(quick)


def _values(components: Column, c: dict, utf8: bool) -> Column:
    """Unescaped values; of a text read as ISO-8859-1 also decoded."""
    one = lambda x: unescape(x, c["release"])
    return F.transform(components, one if utf8 else lambda x: F.decode(F.encode(one(x), "ISO-8859-1"), "UTF-8"))


def _span(start: Column, size: Column) -> Column:
    return F.struct(start.cast("long").alias("start"), (start + size).cast("long").alias("end"))


def _bytes(x: Column, utf8: bool) -> Column:
    return F.octet_length(x) if utf8 else F.length(x)


def _starts(texts: Column, first: Column, utf8: bool) -> Column:
    """Where each text begins, if one separator stands between them. Within one segment, whose size is bounded."""
    none = F.struct(F.array().cast("array<bigint>").alias("before"), first.cast("long").alias("at"))
    add = lambda a, t: F.struct(F.concat(a["before"], F.array(a["at"])).alias("before"), (a["at"] + _bytes(t, utf8) + 1).alias("at"))
    return F.aggregate(texts, none, add, lambda a: a["before"])


def _quick_spans(body: Column, start: Column, c: dict, plain: bool, utf8: bool) -> Column:
    """The elements with spans of a segment without release characters: ends are the sizes of what precedes a separator."""
    part = lambda text, separator, k: _bytes(F.call_function("substring_index", text, _lit(separator), k), utf8).cast("long")

    def one(e: Column, i: Column) -> Column:
        end = start + part(body, c["element"], i + 2)
        own = lambda p, k: F.struct((end - _bytes(e, utf8) + part(e, c["component"], k + 1) - _bytes(p, utf8)).alias("start"), (end - _bytes(e, utf8) + part(e, c["component"], k + 1)).alias("end"))
        p = F.split(e, c["quoted_component"], -1)
        return F.struct(F.struct((end - _bytes(e, utf8)).alias("start"), end.alias("end")).alias("span"), (p if plain and utf8 else _values(p, c, utf8)).alias("components"), F.transform(p, own).alias("component_spans"))

    return F.transform(_element_texts(body, c, True), one)


def _folded_spans(elements: Column, start: Column, c: dict, utf8: bool) -> Column:
    """The same of a segment with release characters: starts are running sums of sizes."""

    def zipped(texts: Column, first: Column) -> Column:
        return F.arrays_zip(texts.alias("t"), _starts(texts, first, utf8).alias("a"))

    def one(pair: Column) -> Column:
        spans = lambda p: F.transform(zipped(p, pair["a"]), lambda x: _span(x["a"], _bytes(x["t"], utf8)))
        return held(_component_texts(pair["t"], c, False), lambda p: F.struct(_span(pair["a"], _bytes(pair["t"], utf8)).alias("span"), _values(p, c, utf8).alias("components"), spans(p).alias("component_spans")))

    return F.transform(held(elements, lambda t: zipped(t, start)), one)


def segment_struct(body: Column, seq: Column, c: dict, *, plain: bool = False, utf8: bool = True, start: Column | None = None, end: Column | None = None) -> Column:
    """The struct of one segment; ``body``: its text without the terminator; ``start`` and ``end``, its places in bytes, add spans."""
    elements = _element_texts(body, c, plain)
    parts = lambda e: _component_texts(e, c, plain)
    values = lambda p: p if plain and utf8 else _values(p, c, utf8)
    head = [seq.cast("long").alias("seq"), F.substring(body, 1, 3).alias("tag")]
    if start is None or end is None:
        return F.struct(*head, F.transform(elements, lambda e: F.struct(values(parts(e)).alias("components"))).alias("elements"))

    quick = _quick_spans(body, start.cast("long"), c, plain, utf8)
    made = quick if plain else F.when(body.contains(_lit(c["release"])), _folded_spans(elements, start.cast("long") + 4, c, utf8)).otherwise(quick)
    return F.struct(*head, F.struct(start.cast("long").alias("start"), end.cast("long").alias("end")).alias("span"), _span(start, F.lit(3)).alias("tag_span"), made.alias("elements"))


def _running(sizes: Column, head: Column) -> Column:
    """``head`` and the sums of the sizes before each place."""

    @F.arrow_udf("array<long>")
    def run(lists: pa.Array, first: pa.Array) -> pa.Array:
        n = np.array([len(x) if x is not None else 0 for x in lists])
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(flat)
        edges = np.concatenate(([0], np.cumsum(n)))
        before = np.concatenate(([0], ends))
        base = first.to_numpy(zero_copy_only=False) - before[edges[:-1]]
        return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(before[:-1] + np.repeat(base, n), pa.int64()))

    return run(sizes, head)


def parse(
    df: DataFrame,
    *,
    content: str = "content",
    chars: ServiceChars | None = None,
    spans: bool = False,
    unterminated: str = "error",
    mode: str = "PERMISSIVE",
    max_segment_bytes: int = MAX_SEGMENT_BYTES,
    service: bool = False,
) -> DataFrame:
    """``df`` without ``content``, with ``segments`` and ``error``.

    chars: fixed service characters; None reads each text's own UNA header.
    unterminated: "error" (a last segment without terminator is E001, or E019 after a lone
    release character) or "accept".
    mode: PERMISSIVE keeps the segments before the error and the error, DROPMALFORMED drops the
    interchange, FAILFAST makes the query fail.
    service: also a column ``service``, the struct of the characters that hold for the text.
    """
    if unterminated not in ("error", "accept") or mode not in ("PERMISSIVE", "DROPMALFORMED", "FAILFAST"):
        raise ValueError("unterminated: error or accept; mode: PERMISSIVE, DROPMALFORMED or FAILFAST")
    if isinstance(chars, ServiceChars) and not chars.valid():
        raise EdiError("E007", text("E007"))
    name = free_names(df, "utf8", "text", "una", "total", "named", "chars", "bad_una", "plain", "raws", "used", "tail", "bodies", "blank", "trimmed", "starts", "bad", "kept", "made")
    col = {k: F.col(v) for k, v in name.items()}
    raw = F.col(content)
    as_text = raw.cast("string")
    utf8 = col["utf8"]
    size = lambda x: F.when(utf8, F.octet_length(x)).otherwise(F.length(x))
    rows = df.withColumn(name["utf8"], F.coalesce(F.is_valid_utf8(as_text), F.lit(True)))
    rows = rows.withColumn(name["text"], F.coalesce(F.when(utf8, as_text).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1")), F.lit("")))
    rows = rows.withColumns({name["total"]: size(col["text"]), name["text"]: _ltrim(col["text"])})
    rows = rows.withColumn(name["una"], col["text"].startswith("UNA") & (size(col["text"]) >= 9))
    bad_una: Column = F.lit(False)
    service_of: ServiceChars | Column = chars or DEFAULT
    if chars is None:
        rows = rows.withColumn(name["named"], service_chars(col["text"], col["una"]))
        patterns = _patterned({n: col["named"][n] for n in ACTIVE})
        rows = rows.withColumn(name["chars"], F.struct(f"{name['named']}.*", *[v.alias(k) for k, v in patterns.items() if k not in ACTIVE]))
        rows = rows.withColumn(name["bad_una"], ~service_valid(col["named"]))
        service_of = col["chars"]
        bad_una = col["bad_una"]
    c = _fields(service_of)
    rows = rows.withColumn(name["text"], F.when(col["una"], _ltrim(F.substring(col["text"], 10, REST))).otherwise(col["text"]))
    head = col["total"] - size(col["text"])
    release = _lit(c["release"])
    rows = rows.withColumn(name["plain"], ~col["text"].contains(release))
    rows = rows.withColumn(name["raws"], F.when(col["plain"], F.split(col["text"], c["quoted_terminator"], -1)).otherwise(F.regexp_extract_all(col["text"], c["live_terminator"], F.lit(1))))
    rows = rows.withColumn(name["used"], F.when(~col["plain"], F.aggregate(col["raws"], F.lit(0), lambda a, r: a + F.length(r) + 1)))

    # What follows the last terminator.
    rows = rows.withColumn(name["tail"], F.when(col["plain"], F.element_at(col["raws"], -1)).otherwise(F.substr(col["text"], col["used"] + 1)))
    rest = _ltrim(col["tail"])
    lone = ~col["plain"] & ((F.length(col["tail"]) - F.length(F.rtrim(col["tail"], release))) % 2 == 1)
    last = F.when(rest == "", no_error()).when(lone, error("E019", offset=(col["total"] - 1).cast("long")))
    bodies = F.when(col["plain"], F.slice(col["raws"], F.lit(1), F.size(col["raws"]) - 1)).otherwise(col["raws"])
    if unterminated == "error":
        last = last.otherwise(error("E001", offset=col["total"].cast("long")))
    else:
        last = last.otherwise(no_error())
        bodies = F.when((rest != "") & ~lone, F.concat(bodies, F.array(col["tail"]))).otherwise(bodies)
    rows = rows.withColumn(name["bodies"], bodies)

    # Each segment's own text without the blanks before it.
    blank = F.lit(False)
    for b in BLANKS:
        blank = blank | col["text"].contains(F.concat(_lit(c["terminator"]), F.lit(b)))
    rows = rows.withColumn(name["blank"], blank)
    rows = rows.withColumn(name["trimmed"], F.when(col["blank"], F.transform(col["bodies"], _ltrim)).otherwise(col["bodies"]))
    if spans:
        rows = rows.withColumn(name["starts"], _running(F.transform(col["bodies"], lambda b: (size(b) + 1).cast("long")), head.cast("long")))

    # The first segment that breaks a rule.
    wrong_tag = lambda b: ~_good_tag(b, c)
    too_long = lambda b: size(b) + 1 > max_segment_bytes
    not_text = lambda b: ~F.is_valid_utf8(F.encode(b, "ISO-8859-1").cast("string"))
    wrong = lambda b: wrong_tag(b) | too_long(b) | (~utf8 & not_text(b))
    some = F.exists(col["trimmed"], wrong_tag) | ((col["total"] > max_segment_bytes) & F.exists(col["trimmed"], too_long)) | ~utf8
    rows = rows.withColumn(name["bad"], F.when(some, F.coalesce(F.array_position(F.transform(col["trimmed"], wrong), True), F.lit(0))).otherwise(F.lit(0)).cast("int"))
    at = col["bad"] - 1
    body, own = F.get(col["bodies"], at), F.get(col["trimmed"], at)
    offset = (F.aggregate(F.slice(col["bodies"], F.lit(1), at), head, lambda a, b: a + size(b) + 1) + size(body) - size(own)).cast("long")
    tag = _before(own, c)
    first = (
        F.when(too_long(own), error("E020", offset=offset, limit=max_segment_bytes))
        .when(tag == "", error("E002", offset=offset, byte=F.hex(F.encode(F.coalesce(F.nullif(F.substring(own, 1, 1), F.lit("")), _lit(c["terminator"])), "ISO-8859-1"))))
        .when(wrong_tag(own), error("E006", tag=F.concat(F.lit('"'), tag, F.lit('"'))))
        .otherwise(error("E003", offset=offset))
    )
    first = F.when(bad_una, error("E007")).when(col["bad"] > 0, first).otherwise(last)
    cut = lambda x: F.when(bad_una, F.slice(x, 1, 0)).when(col["bad"] > 0, F.slice(x, F.lit(1), at)).otherwise(x)
    if spans:
        blanks = lambda b, i: F.when(col["blank"], size(F.get(col["bodies"], i)) - size(b)).otherwise(0)
        placed = F.transform(col["trimmed"], lambda b, i: F.struct(b.alias("b"), (F.get(col["starts"], i) + blanks(b, i)).alias("a")))
        rows = rows.withColumn(name["kept"], cut(placed))
    else:
        rows = rows.withColumn(name["kept"], cut(col["trimmed"]))

    def build(plain: bool, as_utf8: bool) -> Column:
        def of(x: Column, i: Column) -> Column:
            if not spans:
                return segment_struct(x, i, c, plain=plain, utf8=as_utf8)
            end = F.least(x["a"] + _bytes(x["b"], as_utf8) + 1, col["total"].cast("long"))
            return segment_struct(x["b"], i, c, plain=plain, utf8=as_utf8, start=x["a"], end=end)

        return F.transform(col["kept"], of)

    segments = F.when(col["plain"] & utf8, build(True, True)).when(utf8, build(False, True)).otherwise(build(False, False))
    if mode == "FAILFAST":
        failed = F.raise_error(F.concat(first["code"], F.lit(": "), first["message"]))
        segments = F.when(first.isNotNull(), failed.cast(_segments_type(spans))).otherwise(segments)
    made = [segments.alias("segments"), first.alias("error")]
    if service:
        own_chars = col["named"] if isinstance(service_of, Column) else F.struct(*[F.lit(getattr(service_of, n)).alias(n) for n in ("component", "element", "decimal", "release", "terminator")], F.lit(True).alias("named"))
        made.append(own_chars.alias("service"))
    keep = [F.col(f"`{x}`") for x in df.columns if x != content]
    out = rows.select(*keep, F.explode_outer(F.array(F.struct(*made))).alias(name["made"])).select(*keep, f"{name['made']}.*")
    return out.where(F.col("error").isNull()) if mode == "DROPMALFORMED" else out


def _segments_type(spans: bool) -> str:
    span = "struct<start:bigint,end:bigint>"
    if spans:
        return f"array<struct<seq:bigint,tag:string,span:{span},tag_span:{span},elements:array<struct<span:{span},components:array<string>,component_spans:array<{span}>>>>>"
    return "array<struct<seq:bigint,tag:string,elements:array<struct<components:array<string>>>>>"


def _good_tag(body: Column, c: dict) -> Column:
    """Three capital letters, then an element separator or the end; the pattern is fixed, so that it is compiled once."""
    e = c["quoted_element"]
    if isinstance(e, str):
        return F.rlike(body, F.lit(rf"^[A-Z]{{3}}(?:{e}|\z)"))
    after = F.substring(body, 4, 1)
    return F.rlike(F.substring(body, 1, 3), F.lit(r"^[A-Z]{3}\z")) & ((after == c["element"]) | (after == ""))


def _before(body: Column, c: dict) -> Column:
    """The tag: what stands before the first element separator, or all."""
    return F.element_at(F.split(body, c["quoted_element"], -1), 1)


def exploded(rows: DataFrame, *keep: Column | str, of: Column | str, name: str) -> DataFrame:
    """A row for each entry of ``of``, an array.

    A plain ``explode`` makes Catalyst infer a filter on the array's size, which it pushes below the projections
    that made the array, with all of them put into each other: the work of a row then grows as a power of its length.
    """
    at = free_names(rows, "at")["at"]
    return rows.select(*keep, F.posexplode_outer(of).alias(at, name)).where(F.col(at).isNotNull()).drop(at)


def explode_segments(parsed: DataFrame) -> DataFrame:
    """A row for each segment: the other columns, then seq, tag, elements (and spans)."""
    keep = [F.col(f"`{c}`") for c in parsed.columns if c not in ("segments", "error")]
    name = free_names(parsed, "one")["one"]
    return parsed.select(*keep, F.explode("segments").alias(name)).select(*keep, f"{name}.*")


def shifted(segments: Column, by: Column | int) -> Column:
    """Segments with spans, all moved by a number of bytes: for a text that is part of a larger one."""
    by = by if isinstance(by, Column) else F.lit(by)
    move = lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"))
    element = lambda e: F.struct(move(e["span"]).alias("span"), e["components"].alias("components"), F.transform(e["component_spans"], move).alias("component_spans"))
    return F.transform(segments, lambda s: F.struct(s["seq"].alias("seq"), s["tag"].alias("tag"), move(s["span"]).alias("span"), move(s["tag_span"]).alias("tag_span"), F.transform(s["elements"], element).alias("elements")))


def tokens(segments: DataFrame) -> DataFrame:
    """(…, seq, pos, kind, value): the token stream of exploded segments, in order of (seq, pos)."""
    keep = [c for c in segments.columns if c not in ("tag", "elements", "span", "tag_span")]
    name = free_names(segments, "token")["token"]
    token = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    inner = F.flatten(F.transform("elements", lambda e: F.transform(e["components"], lambda v, i: F.struct(F.when(i == 0, "element").otherwise("component").alias("kind"), v.alias("value")))))
    all_ = F.concat(F.array(token("tag", F.col("tag"))), inner, F.array(token("terminator", F.lit(None).cast("string"))))
    return segments.select(*keep, F.posexplode(all_).alias("pos", name)).select(*keep, "pos", f"{name}.kind", f"{name}.value")


def events(segments: DataFrame) -> DataFrame:
    """The event stream: start_segment, element, component_element, end_segment."""
    names = F.create_map(*[F.lit(x) for x in ("tag", "start_segment", "element", "element", "component", "component_element", "terminator", "end_segment")])
    return tokens(segments).withColumn("kind", names[F.col("kind")])
