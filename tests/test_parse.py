import random

import pytest
from pyspark.sql import functions as F

from tradewire.errors import EdiError
from tradewire.functions.syntax import DEFAULT, ServiceChars, escape, glob
from tradewire.operators.parse import events, explode_segments, parse, tokens
from tradewire.operators.writer import from_events, segments_text, write_text


def run(spark, *texts, **options):
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "interchange_id string, content string")
    rows = sorted(parse(d, **options).collect(), key=lambda r: int(r.interchange_id))
    return [([(s.tag, [list(e.components) for e in s.elements]) for s in r.segments], r.error.code if r.error else None) for r in rows]


CASES = [
    ("UNA:+.? '\nUNH+1+ORDERS:D'\nUNT+2+1'\n", [("UNH", [["1"], ["ORDERS", "D"]]), ("UNT", [["2"], ["1"]])], None),
    ("BGM+PO?'47?+11??+?:'", [("BGM", [["PO'47+11?"], [":"]])], None),
    ("UNS'BGM+220'", [("UNS", []), ("BGM", [["220"]])], None),
    ("UNA|!,? ~BGM!a|b!c?!d~", [("BGM", [["a", "b"], ["c!d"]])], None),
    ("DTM+'", [("DTM", [[""]])], None),
    ("DTM+::'", [("DTM", [["", "", ""]])], None),
    ("FTX+a\r\nb'", [("FTX", [["a\r\nb"]])], None),
    ("UNH+1'BGM+2", [("UNH", [["1"]])], "E001"),
    ("UNH+1'BGM+2?", [("UNH", [["1"]])], "E019"),
    ("UNH+1'FTX+a?'b", [("UNH", [["1"]])], "E001"),
    ("UNH+1'BGM+2??", [("UNH", [["1"]])], "E001"),
    ("UNH+1'bgm+2'UNT'", [("UNH", [["1"]])], "E006"),
    ("UNH+1'+2'", [("UNH", [["1"]])], "E002"),
    ("UNA::.? 'UNH'", [], "E007"),
    ("UNA: .? 'UNH'", [], "E007"),
    ("UNH+1'UNA:+.? 'UNT'", [("UNH", [["1"]])], "E006"),
    ("", [], None),
    (" \r\n\t", [], None),
    (None, [], None),
    ("NAD+é:ü+ñ'", [("NAD", [["é", "ü"], ["ñ"]])], None),
]


@pytest.mark.parametrize("options", [{}, {"spans": True}])
def test_cases(spark, options):
    got = run(spark, *[c[0] for c in CASES], **options)
    for (text, segments, code), mine in zip(CASES, got, strict=True):
        assert mine == (segments, code), text


def test_unterminated_may_be_accepted(spark):
    assert run(spark, "UNH+1'BGM+2", unterminated="accept") == [([("UNH", [["1"]]), ("BGM", [["2"]])], None)]


def test_size_limit(spark):
    assert run(spark, "UNH+1'FTX+" + "x" * 50 + "'", max_segment_bytes=40)[0][1] == "E020"


def test_invalid_utf8_is_an_error(spark):
    d = spark.createDataFrame([("a", b"UNH+1'FTX+\xff'UNT'")], "interchange_id string, content binary")
    r = parse(d, spans=True).first()
    assert r.error.code == "E003" and r.error.offset == 6 and len(r.segments) == 1


def test_spans_count_bytes(spark):
    d = spark.createDataFrame([("a", "UNA:+.? '\nNAD+é:b?+'QTY+1'")], "interchange_id string, content string")
    a, b = parse(d, spans=True).first().segments
    assert tuple(a.span) == (10, 21) and tuple(a.tag_span) == (10, 13) and tuple(a.elements[0].span) == (14, 20)
    assert [tuple(s) for s in a.elements[0].component_spans] == [(14, 16), (17, 20)] and tuple(b.span) == (21, 27)


def test_modes(spark):
    d = spark.createDataFrame([("a", "UNH'"), ("b", "UNH'x")], "interchange_id string, content string")
    assert parse(d, mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception, match="E001"):
        parse(d, mode="FAILFAST").collect()
    with pytest.raises(ValueError):
        parse(d, mode="x")
    with pytest.raises(EdiError):
        parse(d, chars=ServiceChars(component="+"))


def oracle(text):
    """A plain reading of the syntax, character by character."""
    out, raw, i = [], "", 0
    while i < len(text):
        c = text[i]
        if c == "?" and i + 1 < len(text):
            raw += text[i : i + 2]
            i += 2
            continue
        i += 1
        if c == "'":
            body = raw.lstrip(" \t\r\n")
            parts, cur, k = [[""]], None, 3
            tag, rest = body[:3], body[3:]
            if not (len(tag) == 3 and tag.isascii() and tag.isalpha() and tag.isupper() and rest[:1] in ("", "+")):
                return out, "bad"
            elements = []
            k = 0
            while k < len(rest):
                if rest[k] == "+":
                    elements.append([""])
                elif rest[k] == ":":
                    elements[-1].append("")
                elif rest[k] == "?" and k + 1 < len(rest):
                    k += 1
                    elements[-1][-1] += rest[k]
                else:
                    elements[-1][-1] += rest[k]
                k += 1
            del parts, cur
            out.append((tag, elements))
            raw = ""
        else:
            raw += c
    return out, "bad" if raw.strip(" \t\r\n") else None


def test_random_texts_agree_with_a_plain_reading(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["UNH", "BGM", "+", "+", ":", "?", "'", "'", "a", "é", "\n", " "]) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts = [t for t in texts if not t.lstrip().startswith("UNA")]
    for text, (segments, code) in zip(texts, run(spark, *texts), strict=True):
        want, bad = oracle(text)
        assert segments == want and (code is not None) == (bad is not None), text


def test_round_trip_of_random_segments(spark):
    rng = random.Random(3)
    value = lambda: "".join(rng.choice("ab?+:'\n é") for _ in range(rng.randint(0, 5)))
    rows = [(str(i), [("ABC", [([value() for _ in range(rng.randint(1, 3))],) for _ in range(rng.randint(0, 3))]) for _ in range(3)]) for i in range(60)]
    d = spark.createDataFrame(rows, "interchange_id string, segments array<struct<tag string, elements array<struct<components array<string>>>>>")
    for chars in (DEFAULT, ServiceChars("|", "!", ",", "\\", "~")):
        texts = d.select("interchange_id", segments_text(F.col("segments"), chars, una=True).alias("content"))
        back = {r.interchange_id: r.segments for r in parse(texts).collect()}
        for key, segs in rows:
            assert [(s.tag, [list(e.components) for e in s.elements]) for s in back[key]] == [(t, [list(e[0]) for e in es]) for t, es in segs]


def test_events_and_writer_agree(spark):
    d = spark.createDataFrame([("a", "UNH+1+A:B'FTX+x?+y'UNT+3+1'")], "interchange_id string, content string")
    rows = explode_segments(parse(d))
    assert from_events(events(rows)).first().content == write_text(rows).first().content == "UNH+1+A:B'FTX+x?+y'UNT+3+1'"
    assert [r.kind for r in tokens(rows).orderBy("seq", "pos").collect()][:5] == ["tag", "element", "element", "component", "terminator"]


# Fixed values: (value, pattern, matches).
GLOBS = [("", "", True), ("", "*", True), ("A", "", False), ("MS", "MS", True), ("ms", "MS", False), ("MSX", "MS", False), ("MS", "M*", True), ("", "M*", False), ("MSG", "*G", True), ("MSG", "*X", False), ("MY", "M*Y", True), ("MAYZ", "M*Y", False), ("ABCDE", "A*C*E", True), ("ABCDF", "A*C*E", False), ("AB", "A**B", True), ("AB", "A*B*C", False), ("A.B", "A.*", True), ("AxB", "A.*", False), ("a\nb", "a*b", True), ("a\n", "a", False)]


def test_globs(spark):
    for value, pattern, want in GLOBS:
        assert spark.range(1).select(glob(F.lit(value), pattern)).first()[0] is want, (value, pattern)


def test_escape_is_undone(spark):
    assert spark.range(1).select(escape(F.lit("a?+b:c'"))).first()[0] == "a???+b?:c?'"


def test_una_text():
    assert DEFAULT.una() == "UNA:+.? '"
    with pytest.raises(EdiError):
        ServiceChars(element="é").una()
