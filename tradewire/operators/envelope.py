"""Interchange and message envelopes: extraction and cross-checks, first error in a fixed order.

Order: UNB first, UNZ last, UNB's components, UNZ's reference and its match, UNZ's count, the
message scan by position, an open message, E004, then E005 by message. All of it is a fold over the
array of an interchange's segments: no shuffle, no join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewire.errors import error
from tradewire.functions.access import component_or_empty, required_component
from tradewire.operators.parse import free_names
from tradewire.operators.windows import controls, opened


def count_text(value: Column) -> Column:
    """An unsigned 32-bit count, or null: digits with one optional plus, nothing else."""
    return F.when(value.rlike(r"^\+?[0-9]+$") & (value.try_cast("decimal(38,0)") <= 4_294_967_295), value.try_cast("long"))


def _start(seg: Column, spans: bool) -> Column:
    return seg["span"]["start"] if spans else F.lit(None).cast("long")


def _misplaced(seg: Column, spans: bool) -> Column:
    return error("E011", tag=seg["tag"], message_type="ENVELOPE", offset=_start(seg, spans))


def envelopes(parsed: DataFrame, key: str = "interchange_id") -> DataFrame:
    """(key, interchange, messages, error) of each row of ``parse``; interchange and messages are null with an error."""
    spans = "span" in parsed.schema["segments"].dataType.elementType.names
    names = free_names(parsed, "unb", "unz", "inner", "stray", "opened", "closed", "head", "interchange", "open", "scan", "found", "first")
    col = {k: F.col(v) for k, v in names.items()}
    segments = F.col("segments")
    n = F.size(segments)
    inner = F.when(n > 2, F.slice(segments, F.lit(2), n - 2)).otherwise(F.slice(segments, 1, 0))
    rows = parsed.select(key, "segments", "error", F.get(segments, F.lit(0)).alias(names["unb"]), F.get(segments, n - 1).alias(names["unz"]), inner.alias(names["inner"]))
    unb, unz = col["unb"], col["unz"]
    heads = [required_component(unb, e, 0) for e in range(5)]
    ref = required_component(unz, 1, 0)
    declared = required_component(unz, 0, 0)
    head = F.coalesce(
        F.col("error"),
        F.when((n == 0) | (unb["tag"] != "UNB"), error("E015", tag="UNB", expected_position="beginning of interchange")),
        F.when(unz["tag"] != "UNZ", error("E015", tag="UNZ", expected_position="end of interchange")),
        *[h["error"] for h in heads],
        ref["error"],
        F.when(ref["value"] != heads[4]["value"], error("E016", tag="UNZ", actual=ref["value"], expected=heads[4]["value"], offset=_start(unz, spans))),
        declared["error"],
        F.when(count_text(declared["value"]).isNull(), error("E003", offset=_start(unz, spans))),
    )
    time = component_or_empty(unb, 3, 1)
    interchange = F.struct(
        heads[0]["value"].alias("syntax_identifier"),
        heads[1]["value"].alias("sender"),
        heads[2]["value"].alias("recipient"),
        F.concat(heads[3]["value"], F.when(time != "", F.concat(F.lit(":"), time)).otherwise("")).alias("datetime"),
        heads[4]["value"].alias("control_ref"),
        count_text(declared["value"]).alias("declared_message_count"),
    )
    # The scan between UNB and UNZ: the first segment that stands where none of its tag may.
    state = F.struct(F.lit(False).alias("open"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("stray"))

    def step(a: Column, s: Column) -> Column:
        tag = s["tag"]
        wrong = F.when(a["open"], tag.isin("UNH", "UNB", "UNZ")).otherwise(tag != "UNH")
        return F.struct(F.when(tag == "UNH", True).when(tag == "UNT", False).otherwise(a["open"]).alias("open"), (a["at"] + 1).alias("at"), F.coalesce(a["stray"], F.when(wrong, a["at"])).alias("stray"))

    rows = rows.withColumns({names["stray"]: F.aggregate(col["inner"], state, step), names["opened"]: controls(col["inner"]), names["head"]: head, names["interchange"]: interchange})
    rows = rows.withColumn(names["opened"], F.filter(opened(col["opened"]), lambda o: o["next"] == "UNT"))

    def close(w: Column) -> Column:
        unh, unt = F.get(col["inner"], w["lo"]), F.get(col["inner"], w["hi"])
        parts = [required_component(unh, e, c) for e, c in ((0, 0), (1, 0), (1, 1), (1, 2), (1, 3))]
        count, its_ref = required_component(unt, 0, 0), required_component(unt, 1, 0)
        start = _start(unt, spans)
        wrong = F.coalesce(
            *[p["error"] for p in parts],
            count["error"],
            F.when(count_text(count["value"]).isNull(), error("E003", offset=start)),
            its_ref["error"],
            F.when(its_ref["value"] != parts[0]["value"], error("E016", tag="UNT", actual=its_ref["value"], expected=parts[0]["value"], offset=start)),
        )
        message = F.struct(
            (w["hi"] + 1).cast("long").alias("seq"),
            *[p["value"].alias(name) for p, name in zip(parts, ("message_ref", "message_type", "version", "release", "controlling_agency"), strict=True)],
            component_or_empty(unh, 1, 4).alias("association_code"),
            count_text(count["value"]).alias("declared_segment_count"),
            (w["hi"] - w["lo"] + 1).cast("long").alias("actual_segment_count"),
        )
        return F.struct(w["hi"].alias("at"), wrong.alias("error"), message.alias("message"))

    rows = rows.withColumn(names["closed"], F.transform(col["opened"], close))
    failed = F.get(F.filter(col["closed"], lambda x: x["error"].isNotNull()), F.lit(0))
    stray = col["stray"]["stray"]
    scan = F.when(stray.isNotNull() & (failed.isNull() | (stray < failed["at"])), _misplaced(F.get(col["inner"], stray), spans)).otherwise(failed["error"])
    rows = rows.withColumns({names["scan"]: scan, names["found"]: F.transform(col["closed"], lambda x: x["message"])})
    found, wanted = col["found"], col["interchange"]["declared_message_count"]
    off = F.get(F.filter(found, lambda m: m["declared_segment_count"] != m["actual_segment_count"]), F.lit(0))
    first = F.coalesce(
        col["head"],
        col["scan"],
        F.when(col["stray"]["open"], error("E015", tag="UNT", expected_position="end of message group")),
        F.when(wanted != F.size(found), error("E004", expected=wanted, actual=F.size(found))),
        F.when(off.isNotNull(), error("E005", message_ref=off["message_ref"], expected=off["declared_segment_count"], actual=off["actual_segment_count"])),
    )
    rows = rows.withColumn(names["first"], first)
    whole = col["first"].isNull()
    full = col["interchange"].withField("actual_message_count", F.size(found).cast("long"))
    return rows.select(key, F.when(whole, full).alias("interchange"), F.when(whole, found).alias("messages"), col["first"].alias("error"))
