"""Reading and writing interchanges: whole files, text records and large files in byte ranges."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tradewire.errors import error, no_error
from tradewire.functions.syntax import ServiceChars, quoted, service_chars
from tradewire.operators.parse import MAX_SEGMENT_BYTES, free_names, parse


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(interchange_id, content) of each file: one interchange a file, as bytes."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.col("path").alias("interchange_id"), "content")


def split_interchanges(df: DataFrame, content: str = "content", key: str = "interchange_id") -> DataFrame:
    """Rows whose text holds several interchanges become one row each (key#n), with ``error`` (null where whole).

    Each interchange is read by its own UNA header, or by the default characters. What belongs to none,
    and a null text, comes out as a row of its own with E015: nothing is dropped but blanks.
    """
    keep = [c for c in df.columns if c not in (content, key)]
    name = free_names(df, "key", "part", "una", "chars", "pattern", "rows", "row", "n")
    col = {k: F.col(v) for k, v in name.items()}
    body = F.coalesce(F.col(content).cast("string"), F.lit(""))
    # A header opens a part that its characters rule.
    rows = df.select(*keep, F.col(key).alias(name["key"]), F.posexplode(F.split(body, r"(?s)(?=UNA.{6}\s*UNB)", -1)).alias(name["n"], name["part"]))
    rows = rows.where((F.trim(col["part"]) != "") | (col["n"] == 0))
    rows = rows.withColumn(name["chars"], service_chars(col["part"]))
    e, r, t = (quoted(col["chars"][x]) for x in ("element", "release", "terminator"))
    pattern = F.concat(F.lit(r"(?s)(?:UNA.{6}\s*)?UNB"), e, F.lit("(?:[^"), t, r, F.lit("]++|"), r, F.lit(".|"), t, F.lit(r"(?!\s*UNZ["), e, t, F.lit("]))*+"), t, F.lit(r"\s*UNZ(?:[^"), t, r, F.lit("]++|"), r, F.lit(".)*+"), t)
    rows = rows.withColumn(name["pattern"], pattern)
    whole = F.transform(F.regexp_extract_all(col["part"], col["pattern"], F.lit(0)), lambda x: F.struct(x.alias("text"), no_error().alias("error")))
    rest = F.filter(F.split(F.regexp_replace(col["part"], col["pattern"], F.lit("\0")), "\0", -1), lambda x: x.rlike(r"\S") | (col["part"] == ""))
    starts = lambda x: x.rlike("^\\s*(?:UNA.{6}\\s*)?UNB")
    lost = F.transform(rest, lambda x: F.struct(x.alias("text"), F.when(starts(x), error("E015", tag="UNZ", expected_position="end of interchange")).otherwise(error("E015", tag="UNB", expected_position="beginning of interchange")).alias("error")))
    rows = rows.select(*keep, col["key"], col["n"], F.posexplode(F.concat(whole, lost)).alias(name["rows"], name["row"]))
    number = F.concat(F.col(name["n"]).cast("string"), F.lit("."), F.col(name["rows"]).cast("string"))
    return rows.select(*keep, F.concat(col["key"], F.lit("#"), number).alias(key), F.col(f"{name['row']}.text").alias(content), F.col(f"{name['row']}.error").alias("error"))


def write_files(df: DataFrame, path: str, content: str = "content", mode: str = "errorifexists") -> None:
    """One text record a row, each ended by a line feed, which readers skip between segments; many part files."""
    df.select(F.col(content).alias("value")).write.mode(mode).option("lineSep", "\n").text(path)


class _Range(InputPartition):
    def __init__(self, path: str, start: int, end: int, head: bytes, failure: str | None = None):
        self.path, self.start, self.end, self.head, self.failure = path, start, end, head, failure


def _una(head: bytes) -> tuple[bytes, bytes, int, str]:
    """(release, terminator, bytes of the header, the header)."""
    text = head.lstrip(b" \t\r\n")
    if text.startswith(b"UNA") and len(text) >= 9:
        return text[6:7], text[8:9], len(head) - len(text) + 9, text[:9].decode("latin-1")
    return b"?", b"'", 0, ""


class _RangeReader(DataSourceReader):
    """Segments of large files on a file system that all executors mount. A split begins after the first
    terminator before which stands an even run of release characters, which needs no earlier text.
    A segment above the limit is E020 and is not held beyond it; an unreadable file is E010."""

    def __init__(self, options: dict):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.size = int(options.get("splitBytes", 64 << 20))
        self.limit = int(options.get("maxSegmentBytes", 65_536))

    def partitions(self) -> list[_Range]:
        import os

        out = []
        for p in self.paths:
            try:
                with open(p, "rb") as f:
                    head = f.read(64)
                n = os.path.getsize(p)
                out += [_Range(p, a, min(n, a + self.size), head) for a in range(0, max(n, 1), self.size)]
            except OSError as e:
                out.append(_Range(p, 0, 0, b"", str(e)))
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        if part.failure is not None:
            yield (part.path, 0, part.failure, "E010", "")
            return
        try:
            yield from self._segments(part)
        except OSError as e:
            yield (part.path, part.start, str(e), "E010", "")

    def _segments(self, part: _Range) -> Iterator[tuple]:
        release, end, skip, header = _una(part.head)
        with open(part.path, "rb") as f:
            at = max(part.start, skip)
            if part.start > skip:
                at = self._aligned(f, part.start, release, end)
            if at is None or at >= part.end:
                return
            f.seek(at)
            held, begin, done, skipping = b"", at, False, False
            while not done:
                block = f.read(1 << 16)
                held += block
                pos = 0
                while True:
                    cut = self._find(held, pos, release, end)
                    if cut < 0:
                        break
                    raw = held[pos : cut + 1]
                    lead = len(raw) - len(raw.lstrip(b" \t\r\n"))
                    if not skipping:
                        yield (part.path, begin + pos + lead, raw[lead:].decode("utf-8", "replace"), "E020" if len(raw) - lead > self.limit else None, header)
                    skipping = False
                    pos = cut + 1
                    if begin + pos >= part.end:
                        done = True
                        break
                held, begin = held[pos:], begin + pos
                if block and not done and len(held.lstrip(b" \t\r\n")) > self.limit:  # no need to hold what is too long already
                    lead = len(held) - len(held.lstrip(b" \t\r\n"))
                    if not skipping:
                        yield (part.path, begin + lead, held[lead : lead + self.limit].decode("utf-8", "replace"), "E020", header)
                    skipping = True
                    run = len(held) - len(held.rstrip(release))  # a run of release characters at the end goes on in the next block
                    begin, held = begin + len(held) - run, held[len(held) - run :]
                if not block and not done:
                    rest = held.strip(b" \t\r\n")
                    if rest and not skipping:
                        lone = (len(rest) - len(rest.rstrip(release))) % 2 == 1
                        yield (part.path, begin + len(held) - len(held.lstrip(b" \t\r\n")), rest.decode("utf-8", "replace"), "E019" if lone else "E001", header)
                    done = True

    @staticmethod
    def _find(data: bytes, at: int, release: bytes, end: bytes) -> int:
        while (i := data.find(end, at)) >= 0:
            k = i
            while k > 0 and data[k - 1 : k] == release:
                k -= 1
            if (i - k) % 2 == 0:
                return i
            at = i + 1
        return -1

    def _aligned(self, f, start: int, release: bytes, end: bytes) -> int | None:
        """The place after the first live terminator at or after start - 1."""
        back = max(0, start - 4096)
        f.seek(back)
        data = f.read(start - back)
        base = back
        at = max(0, len(data) - 1)
        while True:
            i = self._find(data, at, release, end)
            if i >= 0:
                return base + i + 1
            more = f.read(1 << 16)
            if not more:
                return None
            at = len(data)
            data += more


class _PartWriter(DataSourceWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite

    def write(self, rows: Iterator) -> WriterCommitMessage:
        import os
        import uuid

        os.makedirs(self.path, exist_ok=True)
        name = os.path.join(self.path, f"part-{uuid.uuid4().hex}.edi")
        with open(name + ".tmp", "wb") as f:
            for r in rows:
                f.write(r[0].encode("utf-8"))
        return _Written(name)

    def commit(self, messages: list) -> None:
        import glob
        import os

        if self.overwrite:
            for old in glob.glob(os.path.join(glob.escape(self.path), "part-*.edi")):
                os.remove(old)
        for m in messages:
            if m is not None:
                os.rename(m.name + ".tmp", m.name)

    def abort(self, messages: list) -> None:
        import os

        for m in messages:
            if m is not None and os.path.exists(m.name + ".tmp"):
                os.remove(m.name + ".tmp")


class _Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class EdifactSource(DataSource):
    """format("edifact"): rows (path, offset, raw, error_code, header), a row a segment, splittable; writes a string column."""

    @classmethod
    def name(cls) -> str:
        return "edifact"

    def schema(self) -> str:
        return "path string, offset long, raw string, error_code string, header string"

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _PartWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EdifactSource)


def segments_of_ranges(rows: DataFrame, chars: ServiceChars | None = None, max_segment_bytes: int = MAX_SEGMENT_BYTES) -> DataFrame:
    """(interchange_id, seq, tag, elements, error) from ``format("edifact")`` rows; seq is the byte offset.

    Every row is checked as ``parse`` checks it, by the file's own header unless ``chars`` is given; a row with an
    error has no tag and no elements.
    """
    text = F.coalesce(F.col("raw"), F.lit(""))
    known = F.when(F.col("error_code") == "E020", error("E020", offset=F.col("offset"), limit=max_segment_bytes)).when(F.col("error_code") == "E010", error("E010", detail=F.col("raw")))
    body = F.when(known.isNotNull(), F.lit("")).otherwise(text if chars else F.concat("header", text))
    one = parse(rows.select(F.col("path").alias("interchange_id"), F.col("offset").alias("seq"), F.octet_length("header").alias("lead") if not chars else F.lit(0).alias("lead"), known.alias("known"), body.alias("content")), chars=chars, max_segment_bytes=max_segment_bytes)
    moved = F.when(F.col("error").isNotNull(), F.col("error").withField("offset", F.col("error.offset") - F.col("lead") + F.col("seq")))
    seg = F.get("segments", F.lit(0))
    err = F.coalesce("known", moved)
    return one.select("interchange_id", "seq", F.when(err.isNull(), seg["tag"]).alias("tag"), F.when(err.isNull(), seg["elements"]).alias("elements"), err.alias("error"))
