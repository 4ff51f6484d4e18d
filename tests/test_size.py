"""Plans whose work a row must not grow with copies of an expression, and shuffles of few rows."""

from pyspark.sql import functions as F

from tradewire.functions.syntax import decimal_text
from tradewire.operators import mapping as M
from tradewire.operators import windows as Wn
from tradewire.operators import writer as Wr
from tradewire.operators.parse import events, explode_segments, parse


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def two(spark, text="UNH+1+ORDERS'LIN+1'LIN+2'UNT+4+1'"):
    return spark.createDataFrame([("a", text), ("b", "UNH+2+ORDERS'UNT+2+2'")], "interchange_id string, content string")


def test_spans_compile_no_pattern_a_segment(spark):
    p = parse(two(spark, "UNH+1+é:b'FTX+a?+b:c+d'UNT+x'"), spans=True)
    assert "concat(^[A-Z]{3}" not in plan(p)
    elements = p.where("interchange_id = 'a'").select(F.explode("segments.elements").alias("e")).collect()
    assert [[(x.span.start, x.span.end, [(s.start, s.end) for s in x.component_spans], x.components) for x in r.e] for r in elements] == [
        [(4, 5, [(4, 5)], ["1"]), (6, 10, [(6, 8), (9, 10)], ["é", "b"])],
        [(15, 21, [(15, 19), (20, 21)], ["a+b", "c"]), (22, 23, [(22, 23)], ["d"])],
        [(28, 29, [(28, 29)], ["x"])],
    ]


def test_windows_are_cut_once_a_row(spark):
    p = Wn.messages(parse(two(spark)))
    assert plan(p).count("= UNT") <= 3
    assert sorted((r.interchange_id, r.message_no, r.message_ref) for r in p.collect()) == [("a", 0, "1"), ("b", 0, "2")]


def test_first_match_groups_a_row_an_interchange(spark):
    p, spec = parse(two(spark)), M.Segment("LIN", (M.Field("line", type="int", required=True),))
    mine = M.extract_first(p, spec)
    assert plan(mine).count("Generate") == 1
    assert sorted(map(repr, mine.collect())) == sorted(map(repr, M.extract_first(explode_segments(p), spec).collect()))
    twice = M.extract_first(p.union(p), spec).where("interchange_id = 'a'").collect()
    assert [(r.seq, r.line, r.error) for r in twice] == [(1, 1, None)]


def test_a_stream_in_order_is_grouped_as_whole_texts(spark):
    e = events(explode_segments(parse(two(spark).coalesce(1)))).withColumn("part", F.col("value"))
    assert Wr._joined(e.select("interchange_id", "seq", "pos", "kind", "part"), "interchange_id").count() == 2
    for rows in (e, e.orderBy(F.xxhash64("seq", "pos")), e.repartition(7, "pos"), e.withColumn("pos", F.col("pos") * 2)):
        assert sorted(tuple(r) for r in Wr.from_events(rows).collect()) == [("a", "UNH+1+ORDERS'LIN+1'LIN+2'UNT+4+1'"), ("b", "UNH+2+ORDERS'UNT+2+2'")]


def test_number_text_is_worked_out_once(spark):
    rows = spark.createDataFrame([(x,) for x in (0.0, -1.5, 1e20, -2.5e-7, 1.234e7, float("inf"), float("-inf"), float("nan"), 5e-324, None)], "x double")
    out = rows.select("x", decimal_text(F.col("x")).alias("t"))
    assert plan(out).count("split(") == 1
    assert [r.t for r in out.collect()] == ["0", "-1.5", "1" + "0" * 20, "-0.00000025", "12340000", "inf", "-inf", "NaN", "0." + "0" * 323 + "49", None]


def test_units_are_counted_without_their_normal_form():
    import random

    from tradewire.llm.linededup import _BLANKS, _BREAK, n_units, units

    draw = random.Random(3)
    for _ in range(3000):
        t = "".join(draw.choice([" ", "\n", "\t", "a", "B。", "!", "?", "\r", "\x0b", "\u3000", "é. ", "\x1c", "\u00a0"]) for _ in range(draw.randrange(12)))
        for unit in _BREAK:
            made = list(units(t, unit))
            assert [n for *_, n in made] == [_BLANKS.sub(" ", t[a:b]).strip(" ").lower() for a, b, _ in made]
            assert n_units(t, unit) == sum(1 for *_, n in made if n)


def test_passages_within_sentences_are_found(spark):
    """op5: any 51 words that two texts share lose a passage in the later one, wherever sentences begin."""
    import random

    from tradewire.llm import linededup

    draw = random.Random(5)
    say = lambda n: " ".join("".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 9))) for _ in range(n))
    rows, planted = [], []
    for i in range(30):
        shared = say(51) if i % 3 else say(25) + ".\n" + say(26)
        rows += [(2 * i, f"{say(9)} {shared} {say(30)}"), (2 * i + 1, f"{say(33)}. {say(i)}\n{say(3)} {shared.upper()}, {say(4)}. {say(20)}")]
        planted.append(shared)
    rows += [(100, "长" * 5 + "".join(chr(0x4E00 + draw.randrange(5000)) for _ in range(700))), (102, say(30)), (103, None)]
    rows += [(101, "前言" * 9 + rows[-3][1][40:] + "后记")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    text = dict(rows)
    got = {r.doc_id: r for r in linededup.dedup(df).collect()}
    assert {k for k, r in got.items() if r.removed} == {2 * i + 1 for i in range(30)} | {101}
    for i, shared in enumerate(planted):
        (gone,) = got[2 * i + 1].removed
        cut = text[2 * i + 1][gone.start : gone.end]
        assert cut in shared.upper() and len(cut.split()) >= 40
    (gone,) = got[101].removed
    assert text[101][gone.start : gone.end] in text[100] and gone.end - gone.start > 500


def test_a_passage_does_not_repeat_itself_by_overlap(spark):
    from tradewire.llm import linededup

    rows = [(1, " ".join(["ha ho hi"] * 13)), (2, " ".join(["tick"] * 79)), (3, "\t".join(["Tack"] * 90))]
    got = {r.doc_id: (r.kept_text, r.n_units) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {k: (len(t.split()), n) for k, (t, n) in got.items()} == {1: (39, 1), 2: (79, 1), 3: (40, 1)}
