"""Message windows (UNH to UNT) and runs of matching segments.

Windows are cut from the array of an interchange's segments, so nothing is shuffled. Segments that come
as rows (from byte ranges, say) are put together first by ``gathered``, in one shuffle. Runs number the
rows of exploded segments, in one shuffle by interchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewire.errors import error
from tradewire.functions.access import segment_matches
from tradewire.operators.parse import exploded, free_names


def gathered(segments: DataFrame, key: str = "interchange_id") -> DataFrame:
    """(key, segments) of each interchange from its exploded segments."""
    fields = [c for c in ("seq", "tag", "span", "tag_span", "elements") if c in segments.columns]
    return segments.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("segments"))


def controls(segments: Column) -> Column:
    """(tag, at) of each UNH and UNT in order."""
    return F.filter(F.transform(segments, lambda s, i: F.struct(s["tag"].alias("tag"), i.alias("at"))), lambda c: c["tag"].isin("UNH", "UNT"))


def opened(marks: Column) -> Column:
    """(lo, hi, next) of each UNH among ``controls``: its place, and place and tag of the control after it (null at the end)."""
    each = F.transform(marks, lambda c, k: F.struct(c["tag"].alias("tag"), c["at"].alias("lo"), F.get(marks, k + 1)["at"].alias("hi"), F.get(marks, k + 1)["tag"].alias("next")))
    return F.filter(each, lambda o: o["tag"] == "UNH")


def windowed(parsed: DataFrame) -> DataFrame:
    """``parsed`` with ``messages``, an array of (message_no, segments) of each whole window, and ``window_error`` (seq, error).

    The first UNH in an open window (E011), or an open window at the end (E001), ends the windows.
    """
    spans = "span" in parsed.schema["segments"].dataType.elementType.names
    name = free_names(parsed, "marks", "opened", "bad")
    seg = F.col("segments")
    rows = parsed.withColumn(name["marks"], controls(seg))
    rows = rows.withColumn(name["opened"], opened(F.col(name["marks"])))
    rows = rows.withColumn(name["bad"], F.get(F.filter(name["opened"], lambda o: F.coalesce(o["next"], F.lit("")) != "UNT"), F.lit(0)))
    bad, last = F.col(name["bad"]), F.size(seg) - 1
    whole = F.filter(name["opened"], lambda o: (o["next"] == "UNT") & (bad.isNull() | (o["lo"] < bad["lo"])))
    cut = F.transform(whole, lambda w, k: F.struct(k.cast("int").alias("message_no"), F.slice(seg, w["lo"] + 1, w["hi"] - w["lo"] + 1).alias("segments")))
    none = F.lit(None).cast("long")
    nested = error("E011", tag="UNH", message_type="ENVELOPE", offset=F.get(seg, bad["hi"])["span"]["start"] if spans else none)
    ends = error("E001", offset=F.get(seg, last)["span"]["end"] if spans else none)
    wrong = F.when(bad["next"] == "UNH", F.struct(bad["hi"].cast("long").alias("seq"), nested.alias("error"))).when(bad.isNotNull(), F.struct(last.cast("long").alias("seq"), ends.alias("error")))
    return rows.withColumns({"messages": cut, "window_error": wrong.otherwise(F.lit(None))}).drop(*name.values())


def window_errors(parsed: DataFrame, key: str = "interchange_id") -> DataFrame:
    """(key, seq, error): the error that ends each interchange's windows: a UNH in an open window (E011) or none to close it (E001)."""
    return windowed(parsed).where(F.col("window_error").isNotNull()).select(key, "window_error.seq", "window_error.error")


def messages(parsed: DataFrame, key: str = "interchange_id") -> DataFrame:
    """A row for each whole window: key, message_no, message_ref, message_type and its segments in order."""
    rows = exploded(windowed(parsed), key, of="messages", name="m").select(key, "m.message_no", "m.segments")
    return with_heads(rows)


def with_heads(rows: DataFrame) -> DataFrame:
    """Add the reference and type named by the first UNH of ``segments``."""
    unh = F.get(F.filter("segments", lambda s: s["tag"] == "UNH"), F.lit(0))
    part = lambda n: F.get(F.get(unh["elements"], F.lit(n))["components"], F.lit(0))
    return rows.withColumns({"message_ref": part(0), "message_type": part(1)})


def runs(segments: DataFrame, tag: str, qualifier: str | None = None, key: str | list[str] = "interchange_id") -> DataFrame:
    """The matching segments with ``run`` (from 0): which maximal row of neighbours each belongs to."""
    keys = [key] if isinstance(key, str) else key
    name = free_names(segments, "at", "island")
    line = W.partitionBy(*keys).orderBy("seq")
    place = segments.withColumn(name["at"], F.row_number().over(line)).where(segment_matches(F.struct("tag", "elements"), tag, qualifier))
    place = place.withColumn(name["island"], F.col(name["at"]) - F.row_number().over(line))
    return place.withColumn("run", F.dense_rank().over(W.partitionBy(*keys).orderBy(name["island"])) - 1).drop(*name.values())


def contiguous(parsed: DataFrame, tag: str, qualifier: str | None = None, key: str = "interchange_id") -> DataFrame:
    """(key, contiguous): whether the matching segments of each interchange form one run at most."""
    hits = F.filter(F.transform("segments", lambda s, i: F.when(segment_matches(s, tag, qualifier), i)), lambda i: i.isNotNull())
    first, last = F.get(hits, F.lit(0)), F.get(hits, F.size(hits) - 1)
    return parsed.select(key, F.coalesce(last - first + 1 == F.size(hits), F.lit(True)).alias("contiguous"))

