import pytest

from tradewire.operators.parse import explode_segments, parse
from tradewire.operators.validate import DirectoryValidator, ElementRef, SegmentDefinition, ValidationContext
from tradewire.sources import edifact as S
from tradewire.streaming.windows import chunked_messages, parse_stream, step, validated

TEXT = "UNA:+.? '\n" + "".join(f"UNH+{i}+A:B'\nFTX+x?'y??+{'z' * (i % 7)}'UNT+3+{i}'\r\n" for i in range(200))


@pytest.mark.parametrize("split", [97, 300, 1000, 1 << 20])
def test_any_split_gives_the_same_segments(tmp_path, split):
    p = tmp_path / "a.edi"
    p.write_text(TEXT, newline="")
    reader = S._RangeReader({"path": str(p), "splitBytes": str(split)})
    got = [row for part in reader.partitions() for row in reader.read(part)]
    whole = S._RangeReader({"path": str(p)})
    assert got == list(whole.read(whole.partitions()[0])) and len(got) == 600


def ranges(spark, path, **options):
    S.register(spark)
    reader = spark.read.format("edifact").option("path", str(path))
    for k, v in options.items():
        reader = reader.option(k, v)
    return reader.load()


@pytest.mark.parametrize("text", [TEXT, TEXT.replace(":+.? '", "|!.\\ ~").translate(str.maketrans("+:?'", "!|\\~"))])
def test_ranges_agree_with_the_parser(spark, tmp_path, text):
    p = tmp_path / "a.edi"
    p.write_text(text, newline="")
    rows = S.segments_of_ranges(ranges(spark, p, splitBytes=4000)).orderBy("seq").collect()
    got = [(r.seq, r.tag, [list(e.components) for e in r.elements]) for r in rows]
    d = spark.createDataFrame([("a", text)], "interchange_id string, content string")
    want = [(r.span.start, r.tag, [list(e.components) for e in r.elements]) for r in explode_segments(parse(d, spans=True)).orderBy("seq").collect()]
    assert got == want and len(want) == 600


def test_range_errors_are_rows(spark, tmp_path):
    (tmp_path / "a.edi").write_text("UNH+1'bgm+2'FTX+" + "x" * 200_000 + "'UNT+1'BGM+2?")
    rows = S.segments_of_ranges(ranges(spark, tmp_path / "a.edi", maxSegmentBytes=1000), max_segment_bytes=1000).orderBy("seq").collect()
    assert [(r.seq, r.tag, r.error and r.error.code) for r in rows] == [(0, "UNH", None), (6, None, "E006"), (12, None, "E020"), (200_017, "UNT", None), (200_023, None, "E019")]
    assert rows[4].error.offset == 200_028
    missing = S.segments_of_ranges(ranges(spark, tmp_path / "none.edi")).collect()
    assert [r.error.code for r in missing] == ["E010"] and "none.edi" in missing[0].error.message


def test_files_and_writer(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.edi").write_text("UNH+1'UNT+2+1'")
    d = S.read_files(spark, str(tmp_path / "in"))
    assert [s.tag for s in parse(d).first().segments] == ["UNH", "UNT"]
    S.register(spark)
    for mode, n in (("append", 1), ("append", 2), ("overwrite", 1)):
        d.selectExpr("string(content) AS content").write.format("edifact").mode(mode).option("path", str(tmp_path / "out")).save()
        assert [p.read_text() for p in (tmp_path / "out").glob("*.edi")] == ["UNH+1'UNT+2+1'"] * n
    S.write_files(d.selectExpr("string(content) AS content"), str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).first()[0] == "UNH+1'UNT+2+1'"


def test_split_interchanges(spark):
    one = "UNB+A?'UNZ'UNH+1'UNT+2+1'UNZ+1+7'"
    own = "UNA|!.\\ ~UNB!B~UNZ!0!8~"
    rows = [("a", one + "\n" + one), ("b", f"{one}{own}\nBGM'"), ("c", "BGM+1'"), ("d", "UNB+A'UNH+1'"), ("e", None)]
    d = spark.createDataFrame(rows, "interchange_id string, content string")
    got = {}
    for r in S.split_interchanges(d).orderBy("interchange_id").collect():
        got.setdefault(r.interchange_id.split("#")[0], []).append((r.content, r.error and r.error.message.split()[2]))
    assert got["a"] == [(one, None), (one, None)] and got["b"] == [(one, None), (own, None), ("\nBGM'", "UNB")]
    assert got["c"] == [("BGM+1'", "UNB")] and got["d"] == [("UNB+A'UNH+1'", "UNZ")] and got["e"] == [("", "UNB")]


def test_chunks_give_what_the_whole_gives():
    text = "UNH+1'FTX+a?'b'UNT'UNH+2'UNT'BGM'UNH+3'"
    whole = step(("", "", False, 0, False), text)
    for size in (1, 2, 3, 5):
        state, out = ("", "", False, 0, False), []
        for at in range(0, len(text), size):
            state, new = step(state, text[at : at + size])
            out += new
        assert (state, out) == whole
    assert whole[1] == [(0, "UNH+1'FTX+a?'b'UNT'", None), (1, "UNH+2'UNT'", None)] and whole[0][2]


def test_streams(spark, tmp_path):
    src = tmp_path / "s"
    rows = [("k", 0, "UNH+1'FT"), ("k", 2, "+1'UNH+2'UNH+3'"), ("k", 1, "X+a'UNT+3"), ("k", 3, None)]
    rows += [("u", i, x) for i, x in enumerate(["UN", "A|!.\\", " ~UNH!1~UN", "T!2~"])] + [("big", 0, "UNH+1'" + "FTX+aaaaaaaaaaaa'" * 40)]
    spark.createDataFrame(rows, "interchange_id string, chunk_no long, content string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("interchange_id string, chunk_no long, content string").parquet(str(src))
    done = chunked_messages(stream, max_window_bytes=500)
    q = done.writeStream.outputMode("append").format("memory").queryName("chunks").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    assert q.awaitTermination(120)
    got = {(r.interchange_id, r.message_no): (r.content, r.error_code) for r in spark.sql("select * from chunks").collect()}
    assert got == {("k", 0): ("UNH+1'FTX+a'UNT+3+1'", None), ("k", 1): (None, "E011"), ("u", 0): ("UNH!1~UNT!2~", None), ("big", 0): (None, "E020")}
    q = parse_stream(stream).writeStream.outputMode("append").format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "d")).trigger(once=True).start()
    assert q.awaitTermination(120)
    assert {"E001", "E002", "E006"} <= {r[0] for r in spark.sql("select error.code from parsed").collect()}


def test_windows_are_validated_as_they_close(spark, tmp_path):
    src = tmp_path / "s"
    rows = [("k", 0, "UNH+1+ORDERS'BGM+220+7'UN"), ("k", 1, "T+3+1'UNH+2+ORDERS'FTX+a'UNT+3+2'UNH+3")]
    spark.createDataFrame(rows, "interchange_id string, chunk_no long, content string").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("interchange_id string, chunk_no long, content string").parquet(str(src))
    known = DirectoryValidator("D", tuple(SegmentDefinition(t, tuple(ElementRef(i + 1) for i in range(3))) for t in ("UNH", "BGM", "UNT"))).enforce_known_tags()
    issues = validated(chunked_messages(stream), ValidationContext().with_validator("structure", known))
    q = issues.writeStream.outputMode("append").format("memory").queryName("issues").option("checkpointLocation", str(tmp_path / "c")).trigger(once=True).start()
    assert q.awaitTermination(120)
    found = {(r.message_no, r.message) for r in spark.sql("select * from issues").collect()}
    assert found == {(1, "segment FTX is not valid for message type D"), (1, "required segment BGM missing for message type ORDERS")}
