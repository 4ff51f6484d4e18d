import pytest
from pyspark.sql import functions as F

from tradewire.errors import CATALOGUE, EdiError, hint, severity
from tradewire.functions import access as A
from tradewire.operators import mapping as M
from tradewire.operators import report as R
from tradewire.operators import validate as V
from tradewire.operators import windows as W
from tradewire.operators.envelope import envelopes
from tradewire.operators.parse import explode_segments, parse

ORDERS = "UNA:+.? '\nUNH+1+ORDERS:D:11A:UN'\nBGM+220+PO-4711+9'\nDTM+137:20260517:102'\nNAD+BY+4000001000002::9'\nNAD+SU+4000001000001::9'\nLIN+1++4012345678901:SRV'\nQTY+21:10:PCE'\nPRI+AAA:12.50'\nUNT+9+1'"


def parsed(spark, *texts, **options):
    return parse(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "interchange_id string, content string"), **options)


def test_catalogue():
    assert list(CATALOGUE) == [f"E{i:03d}" for i in range(1, 22)]
    assert severity("E014") == severity("E016") == "warning" and severity("E013") == "error"
    assert [c for c in CATALOGUE if hint(c) is None] == ["E004", "E005", "E009", "E010", "E018"]


WINDOWS = [
    ("UNH+1'BGM'UNT+3+1'UNH+2'UNT+2+2'", [3, 2], []),
    ("UNB'UNT'UNH+1'UNT'UNZ'", [2], []),
    ("UNH+1'UNT'UNH+2'BGM'", [2], ["E001"]),
    ("UNH+1'UNT'UNH+2'UNH+3'UNT'", [2], ["E011"]),
    ("BGM+1'", [], []),
]


def test_windows(spark):
    segs = parsed(spark, *[w[0] for w in WINDOWS])
    good, bad = {}, {}
    for r in W.messages(segs).orderBy("message_no").collect():
        good.setdefault(int(r.interchange_id), []).append(len(r.segments))
    for r in W.window_errors(segs).collect():
        bad.setdefault(int(r.interchange_id), []).append(r.error.code)
    for i, (_, sizes, codes) in enumerate(WINDOWS):
        assert (good.get(i, []), bad.get(i, [])) == (sizes, codes), WINDOWS[i]


def test_runs(spark):
    rows = parsed(spark, "NAD+BY'NAD+SU'NAD+BY'QTY'NAD+BY'", "NAD+BY'NAD+BX'", "QTY'")
    segs = explode_segments(rows)
    assert {r.interchange_id: len(r.segments) for r in W.gathered(segs).collect()} == {"0": 5, "1": 2, "2": 1}
    assert {(r.interchange_id, r.contiguous) for r in W.contiguous(rows, "NAD", "B*").collect()} == {("0", False), ("1", True), ("2", True)}
    assert W.runs(segs, "NAD", "BY").agg(F.max("run")).first()[0] == 2


GOOD = "UNB+UNOC:3+S+R+260101:1200+7'UNH+1+ORDERS:D:11A:UN'UNT+2+1'UNZ+1+7'"
ENVELOPES = [
    (GOOD, None),
    ("", "E015"),
    (GOOD.replace("UNZ+1+7'", ""), "E015"),
    (GOOD.replace("UNZ+1+7", "UNZ+1+8"), "E016"),
    (GOOD.replace("UNZ+1", "UNZ+2"), "E004"),
    (GOOD.replace("UNZ+1", "UNZ+-1"), "E003"),
    (GOOD.replace("UNZ+1", "UNZ+4294967296"), "E003"),
    (GOOD.replace("UNZ+1", "UNZ+?+1"), None),
    (GOOD.replace("UNT+2+1", "UNT+3+1"), "E005"),
    (GOOD.replace("UNT+2+1", "UNT+2+9"), "E016"),
    (GOOD.replace("UNT+2+1'", ""), "E015"),
    (GOOD.replace("UNT+2", "UNG+1'UNT+2"), "E005"),
    (GOOD.replace("UNH+1", "UNG+1'UNH+1", 1), "E011"),
    (GOOD.replace("UNT+2+1'", "UNT+2+1'UNT+2+1'"), "E011"),
    (GOOD.replace("ORDERS:D:11A:UN", "ORDERS:D"), "E021"),
    (GOOD.replace("+S+R", "++R"), "E021"),
    (GOOD + GOOD, "E011"),
]


def test_envelopes(spark):
    rows = {int(r.interchange_id): r for r in envelopes(parsed(spark, *[e[0] for e in ENVELOPES])).collect()}
    for i, (text, code) in enumerate(ENVELOPES):
        assert (rows[i].error.code if rows[i].error else None) == code, text
    first = rows[0]
    assert first.interchange.datetime == "260101:1200" and first.messages[0].actual_segment_count == 2


def test_accessors(spark):
    d = parsed(spark, ORDERS)
    s = F.col("segments")
    nad, dtm = A.find_first(s, "NAD", "SU"), A.find_first(s, "DTM")
    r = d.select(A.component(nad, 1), A.component_or_empty(nad, 1, 1), A.optional(nad, 1, 1), A.component(nad, 9), A.required_component(dtm, 0, 7)["error"]["code"], A.required_component(dtm, 3, 0)["error"]["code"], A.required_element(dtm, 0)["value"], A.repeating_components(dtm, 0, 1, 2)["value"], A.code_element(dtm, 0, "int")["value"], A.code_element(nad, 0, "int")["error"]["code"], F.size(A.find_all(s, "NAD")), A.any_match(s, "ZZZ"), A.trimmed_size(F.array(F.lit("a"), F.lit(""), F.lit("b"), F.lit("")))).first()
    assert tuple(r) == ("4000001000001", "", None, None, "E021", "E008", "137", ["20260517", "102"], 137, "E003", 2, False, 3)


def test_mapping(spark):
    line = M.Segment("LIN", (M.Field("number", type="int", required=True), M.Field("item", 2, 0), M.Field("kind", 2, 1)))
    spec = M.Message((M.Part("dated", M.Segment("DTM", (M.Field("day", 0, 1, type="date"),), qualifier="137"), required=True), M.Part("lines", line, many=True), M.Part("note", M.Segment("FTX", (M.Field("text"),)))))
    d = V.as_messages(parsed(spark, ORDERS, "UNH+1'LIN+x'UNT+3+1'", "UNH+1'DTM+137:20260101'LIN'UNT'"))
    rows = {r.interchange_id: r for r in M.map_messages(d, spec).collect()}
    assert str(rows["0"].dated.day) == "2026-05-17" and rows["0"].lines[0].number == 1 and rows["0"].lines[0].kind == "SRV" and rows["0"].note is None and rows["0"].error is None
    assert rows["1"].error.code == "E015" and rows["2"].error.code == "E008"
    text = d.limit(1).select(line.write(line.read(A.find_first(F.col("segments"), "LIN")))).first()[0]
    assert text == "LIN+1++4012345678901:SRV'"


@pytest.mark.parametrize(
    "make",
    [
        lambda: M.Segment("bgm"),
        lambda: M.Segment("BG"),
        lambda: M.Segment("BGM", qualifier="A", qualifier_from="x"),
        lambda: M.Segment("BGM", (M.Field("a"),), qualifier_from="b"),
        lambda: M.Segment("BGM", (M.Field("a"), M.Field("a"))),
        lambda: M.Segment("BGM", (M.Field("a", 0), M.Field("b", 0))),
        lambda: M.Segment("BGM", (M.Field("a", 0, composite=True), M.Field("b", 0, 1))),
        lambda: M.Field("not a name"),
        lambda: M.Field("a", -1),
        lambda: M.Field("a", composite=True, component=1),
        lambda: M.Field("a", composite=True, type="int"),
        lambda: M.Field("a", type="money"),
        lambda: M.Part("a", M.Segment("BGM"), many=True, required=True),
        lambda: M.Part("a", M.Segment("BGM", qualifier="A"), qualifier="B"),
        lambda: M.Message(()),
        lambda: M.Message((M.Part("a", M.Segment("BGM")), M.Part("a", M.Segment("DTM")))),
        lambda: V.issue("error", "x", nothing=1),
        lambda: V.ValidationContext().with_layer("other", True),
    ],
)
def test_declarations_are_checked(make, spark):
    with pytest.raises(ValueError):
        make()


def demo_pack():
    def code(s):
        return F.when(A.component(A.find_first(s, "BGM"), 0) == "220", V.issue("error", "profile rule DEMO-P001 violated: BGM document code 220 is rejected in this demo pack", rule_id="DEMO-P001", segment_tag="BGM", element_index=0, suggestion="Use a different BGM document code in this demo pack"))

    def ref(s):
        return F.when(A.component(A.find_first(s, "BGM"), 1) == "PO-4711", V.issue("warning", "profile rule DEMO-P002 warning: purchase-order reference PO-4711 is reserved in this demo pack", rule_id="DEMO-P002", segment_tag="BGM", element_index=1, suggestion="Use a non-reserved reference in this demo pack"))

    return V.RulePack("ORDERS-DEMO").for_message_type("ORDERS").with_rule(code).with_rule(ref)


GOLDEN = """Validation Report:
  Errors (1)
    - profile rule DEMO-P001 violated: BGM document code 220 is rejected in this demo pack [segment=BGM] [rule=DEMO-P001] [element=0] [hint=Use a different BGM document code in this demo pack]
  Warnings (1)
    - profile rule DEMO-P002 warning: purchase-order reference PO-4711 is reserved in this demo pack [segment=BGM] [rule=DEMO-P002] [element=1] [hint=Use a non-reserved reference in this demo pack]"""


def test_report_text(spark):
    found = V.ValidationContext().with_pack(demo_pack()).validate(V.as_messages(parsed(spark, ORDERS)))
    assert R.render(found, "interchange_id").first().report == GOLDEN
    assert [r[0][:9] for r in R.in_order(found).select(R.display()).collect()] == ["[ERROR] p", "[WARNING]"]


def test_layers_scopes_and_strict(spark):
    d = V.as_messages(parsed(spark, ORDERS, "BGM+220'"))
    ctx = V.ValidationContext().with_pack(demo_pack())
    assert ctx.validate(d).count() == 2
    assert ctx.with_layer("profile", False).validate(d).count() == 0
    with pytest.raises(EdiError, match="E018: validation failed with 1 issue"):
        ctx.validate_strict(d)
    merged = demo_pack().merge(V.RulePack("x").for_message_type("INVOIC").for_message_type("ORDERS"))
    assert merged.message_types == ("ORDERS", "INVOIC") and merged.rule_count == 2


def test_directory(spark):
    refs = lambda n, *m: tuple(V.ElementRef(i + 1, i in m) for i in range(n))
    d = V.DirectoryValidator("D11A", (V.SegmentDefinition("DTM", refs(2, 0), components={0: 3}), V.SegmentDefinition("NAD", refs(2, 0, 1), components={1: 3}), V.SegmentDefinition("BGM", refs(3, 0))), {"1001": ("220",), "3035": ("BY", "SU")}, {"1001": "try 220"})
    texts = [ORDERS, "UNH+1+ORDERS'BGM+999'DTM+137:1'NAD+BY+1::9'UNT'", "UNH+1+INVOIC'UNT'", "UNT'UNH+1+X'", "UNH+1+ORDERS'BGM'NAD+ZZ'UNT'"]
    ctx = V.ValidationContext().with_validator("structure", d)
    out = {}
    for r in ctx.validate(V.as_messages(parsed(spark, *texts))).orderBy("ordinal").collect():
        out.setdefault(r.interchange_id, []).append((r.error_code, r.severity, r.suggestion if r.error_code == "E014" else None))
    assert "0" not in out
    assert out["1"] == [("E014", "warning", "try 220"), ("E013", "error", None)]
    assert out["2"] == [(None, "error", None)] and out["3"] == [(None, "error", None)]
    assert [x[0] for x in out["4"]] == ["E012", "E012"]
    only = V.ValidationContext().with_validator("code_list", d.code_list_only()).validate(V.as_messages(parsed(spark, texts[4])))
    assert [r.error_code for r in only.collect()] == ["E014"]
