"""The registered queries of the engine and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.functions import access as A
from tradewire.functions.syntax import DEFAULT, ServiceChars, escape, glob, unescape
from tradewire.operators import mapping as M
from tradewire.operators import report as R
from tradewire.operators import validate as V
from tradewire.operators import windows as Wn
from tradewire.operators import writer as Wr
from tradewire.operators.envelope import envelopes
from tradewire.operators.parse import events, explode_segments, exploded, parse, tokens
from tradewire.plans import build as B

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
PIPES = ServiceChars(component="|", element="!", decimal=",", release="?", terminator="~")


def query(sql: str) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put



def _key(name: str) -> Column:
    return F.col("interchange_id").cast("long").alias(name)


def _segs() -> Column:
    return F.col("segments")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(B.order_messages(spark, sf_dir), chars=DEFAULT)


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse(B.header_messages(spark, sf_dir), chars=DEFAULT)


def _totals(parsed: DataFrame) -> DataFrame:
    qty = A.map_all(_segs(), "QTY", lambda s: A.component(s, 0, 1).cast("long"))
    return parsed.select(_key("order_key"), F.aggregate(qty, F.lit(0).cast("long"), lambda a, x: a + x).alias("total_qty"), F.size(qty).cast("long").alias("n_lines"))


TOTALS = """SELECT l_orderkey AS order_key, CAST(sum(l_quantity) AS BIGINT) AS total_qty, count(*) AS n_lines
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1"""


@query(TOTALS)
def orders_roundtrip_totals(spark, sf_dir):
    """Flagship: orders to text, text to segments, quantity by order."""
    return _totals(_orders(spark, sf_dir))


@query(TOTALS)
def custom_una_roundtrip(spark, sf_dir):
    return _totals(parse(B.order_messages(spark, sf_dir, PIPES, una=True)))


@query(TOTALS)
def binary_latin_roundtrip(spark, sf_dir):
    """The same from bytes, with spans."""
    rows = B.order_messages(spark, sf_dir).withColumn("content", F.col("content").cast("binary"))
    return _totals(parse(rows, spans=True))


@query("SELECT o_orderkey AS order_key, '220' AS document_code, CAST(o_orderkey AS VARCHAR) AS document_number, '9' AS function_code FROM orders")
def bgm_extract(spark, sf_dir):
    spec = M.Segment("BGM", (M.Field("document_code", required=True), M.Field("document_number", required=True), M.Field("function_code")))
    return M.extract_all(explode_segments(_heads(spark, sf_dir).drop("o_orderkey", "o_custkey", "o_orderpriority")), spec).select(_key("order_key"), "document_code", "document_number", "function_code")


@query("SELECT o_orderkey AS order_key, '137' AS qualifier, strftime(o_orderdate, '%Y%m%d') AS value, '102' AS format FROM orders")
def dtm_components(spark, sf_dir):
    seg = A.find_first(_segs(), "DTM")
    return _heads(spark, sf_dir).select(_key("order_key"), *[A.required_component(seg, 0, i)["value"].alias(n) for i, n in enumerate(("qualifier", "value", "format"))])


@query("SELECT o_orderkey AS order_key, CAST(o_orderdate AS DATE) AS ordered, o_custkey AS buyer, true AS no_note, CAST(NULL AS VARCHAR) AS code FROM orders")
def typed_orders(spark, sf_dir):
    """Typed message mapping with a date and a number."""
    spec = M.Message((M.Part("dated", M.Segment("DTM", (M.Field("ordered", 0, 1, type="date", required=True),), qualifier="137"), required=True), M.Part("buyer", M.Segment("NAD", (M.Field("party", 1, 0, type="long", required=True),), qualifier="BY"), required=True), M.Part("note", M.Segment("FTX", (M.Field("text"),)))))
    out = M.map_messages(_heads(spark, sf_dir).drop("error"), spec)
    return out.select(_key("order_key"), F.col("dated.ordered").alias("ordered"), F.col("buyer.party").alias("buyer"), F.col("note").isNull().alias("no_note"), F.col("error.code").alias("code"))


@query("SELECT o_orderkey AS order_key, o_custkey AS buyer FROM orders")
def nad_qualified_buyer(spark, sf_dir):
    return _heads(spark, sf_dir).select(_key("order_key"), A.component(A.find_first(_segs(), "NAD", "BY"), 1).cast("long").alias("buyer"))


@query("SELECT DISTINCT l_orderkey AS order_key, l_suppkey AS supplier FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def nad_qualified_supplier(spark, sf_dir):
    suppliers = F.array_distinct(A.map_all(_segs(), "NAD", lambda s: A.component(s, 1).cast("long"), "SU"))
    return exploded(_orders(spark, sf_dir), _key("order_key"), of=suppliers, name="supplier")


@query("SELECT l_orderkey AS order_key, min(l_linenumber) AS first_line FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def first_line_per_order(spark, sf_dir):
    spec = M.Segment("LIN", (M.Field("line", type="int", required=True),))
    return M.extract_first(_orders(spark, sf_dir), spec).select(_key("order_key"), F.col("line").alias("first_line"))


@query("SELECT o_orderkey AS order_key, 'E015' AS code FROM orders")
def first_match_missing(spark, sf_dir):
    spec = M.Segment("MOA", (M.Field("amount", 0, 1),))
    return M.extract_first(_heads(spark, sf_dir), spec).select(_key("order_key"), F.col("error.code").alias("code"))


@query("SELECT event_id, regexp_full_match(event_type, 'c.*k') AS mid, regexp_full_match(event_type, '.*e.*') AS any_e, event_type = 'view' AS exact FROM events")
def qualifier_glob(spark, sf_dir):
    t = F.col("event_type")
    return B.table(spark, sf_dir, "events").select("event_id", glob(t, "c*k").alias("mid"), glob(t, "*e*").alias("any_e"), glob(t, "view").alias("exact"))


@query("SELECT l_orderkey AS order_key, 0 AS message_no, 'ORDERS' AS message_type, 5 + 3 * count(*) AS n_segments FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY 1")
def message_segment_count(spark, sf_dir):
    out = Wn.messages(_orders(spark, sf_dir))
    return out.select(_key("order_key"), "message_no", "message_type", F.size("segments").cast("long").alias("n_segments"))


@query("""SELECT o_custkey AS customer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS message_no, CAST(o_orderkey AS VARCHAR) AS message_ref FROM orders""")
def messages_per_customer(spark, sf_dir):
    """Interchanges with several messages each."""
    rows = B.header_messages(spark, sf_dir).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "content"))).alias("m"))
    rows = rows.select(F.col("o_custkey").cast("string").alias("interchange_id"), F.array_join(F.transform("m", lambda x: x["content"]), "").alias("content"))
    out = Wn.messages(parse(rows, chars=DEFAULT))
    return out.select(_key("customer"), F.col("message_no").cast("long").alias("message_no"), "message_ref")


@query("""SELECT l_orderkey AS order_key, CASE WHEN l_orderkey % 10 = 0 THEN 'E005' END AS code,
CASE WHEN l_orderkey % 10 = 0 THEN 'segment count mismatch in message ' || l_orderkey || ': UNT declared ' || (6 + 3 * count(*)) || ', found ' || (5 + 3 * count(*)) END AS message,
CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(l_orderkey AS VARCHAR) END AS control_ref,
CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE 5 + 3 * count(*) END AS n_segments
FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders) GROUP BY l_orderkey""")
def envelope_count_mismatch(spark, sf_dir):
    rows = B.order_messages(spark, sf_dir, wrong_unt=F.col("o_orderkey") % 10 == 0, envelope=True)
    out = envelopes(parse(rows, chars=DEFAULT))
    return out.select(_key("order_key"), F.col("error.code").alias("code"), F.col("error.message").alias("message"), F.col("interchange.control_ref").alias("control_ref"), F.get("messages", F.lit(0))["actual_segment_count"].alias("n_segments"))


@query("SELECT DISTINCT l_orderkey AS order_key, CASE WHEN l_orderkey % 7 = 0 THEN 'E001' ELSE 'ok' END AS outcome FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)")
def message_windows_truncated(spark, sf_dir):
    rows = Wn.windowed(parse(B.order_messages(spark, sf_dir, drop_unt=F.col("o_orderkey") % 7 == 0), chars=DEFAULT))
    good = F.transform("messages", lambda _: F.lit("ok"))
    bad = F.filter(F.array(F.col("window_error.error.code")), lambda c: c.isNotNull())
    return exploded(rows, _key("order_key"), of=F.concat(good, bad), name="outcome")


def _event_lines(spark, sf_dir):
    e = B.table(spark, sf_dir, "events")
    line = Wr.segment_text("EVT", [F.col("event_type"), F.col("event_id")])
    rows = e.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", line.alias("line")))).alias("x"))
    body = F.array_join(F.transform("x", lambda x: x["line"]), "")
    return parse(rows.select(F.col("user_id").cast("string").alias("interchange_id"), body.alias("content")), chars=DEFAULT)


ISLANDS = """WITH a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events),
b AS (SELECT user_id, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS island FROM a WHERE event_type = 'click')"""


@query(ISLANDS + " SELECT user_id, count(*) AS n_segments, count(DISTINCT island) AS n_runs FROM b GROUP BY 1")
def contiguous_line_groups(spark, sf_dir):
    r = Wn.runs(explode_segments(_event_lines(spark, sf_dir)), "EVT", "click")
    return r.groupBy("interchange_id").agg(F.count("*").alias("n_segments"), (F.max("run") + 1).cast("long").alias("n_runs")).select(_key("user_id"), "n_segments", "n_runs")


@query(ISLANDS + " SELECT u.user_id, coalesce(n, 0) <= 1 AS contiguous FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, count(DISTINCT island) AS n FROM b GROUP BY 1) c ON u.user_id = c.user_id")
def groups_are_contiguous(spark, sf_dir):
    return Wn.contiguous(_event_lines(spark, sf_dir), "EVT", "click").select(_key("user_id"), "contiguous")


@query("SELECT doc_id, replace(replace(replace(replace(text, '?', '??'), '+', '?+'), ':', '?:'), '''', '?''') AS escaped FROM documents")
def escape_text(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", escape(F.col("text")).alias("escaped"))


def _payload(parsed: DataFrame, key: str) -> DataFrame:
    return parsed.select(_key(key), A.component_or_empty(A.find_first(_segs(), "FTX"), 3).alias("payload"))


@query("SELECT doc_id, text AS payload FROM documents")
def unescape_roundtrip(spark, sf_dir):
    return _payload(parse(B.text_messages(B.table(spark, sf_dir, "documents"), "doc_id", "text"), chars=DEFAULT, max_segment_bytes=1 << 30), "doc_id")


@query("SELECT page_id, html AS payload FROM pages")
def html_payload_roundtrip(spark, sf_dir):
    return _payload(parse(B.text_messages(B.table(spark, sf_dir, "pages"), "page_id", "html"), chars=DEFAULT, max_segment_bytes=1 << 30), "page_id")


@query("SELECT doc_id, text AS unescaped FROM documents")
def unescape_text(spark, sf_dir):
    return B.table(spark, sf_dir, "documents").select("doc_id", unescape(escape(F.col("text"))).alias("unescaped"))


@query("SELECT kind, CAST(sum(n) AS BIGINT) AS n FROM (SELECT unnest(['tag', 'element', 'component', 'terminator']) AS kind, unnest([5, 10, 7, 5]) * (SELECT count(*) FROM orders) AS n) GROUP BY 1")
def token_kinds(spark, sf_dir):
    return tokens(explode_segments(_heads(spark, sf_dir))).groupBy("kind").agg(F.count("*").alias("n"))


HEAD_TEXT = "'UNH+' || o_orderkey || '+ORDERS:D:11A:UN''BGM+220+' || o_orderkey || '+9''DTM+137:' || strftime(o_orderdate, '%Y%m%d') || ':102''NAD+BY+' || o_custkey || '::9''UNT+5+' || o_orderkey || ''''"


@query(f"SELECT o_orderkey AS order_key, {HEAD_TEXT} AS content FROM orders")
def events_to_text(spark, sf_dir):
    """Segments to an event stream and back to text."""
    rows = explode_segments(_heads(spark, sf_dir).select("interchange_id", "segments", "error"))
    return Wr.from_events(events(rows)).select(_key("order_key"), "content")


@query(f"SELECT o_orderkey AS order_key, {HEAD_TEXT} AS content, 5 AS n_segments FROM orders".replace("5 AS n", "CAST(5 AS BIGINT) AS n"))
def segments_to_text(spark, sf_dir):
    rows = explode_segments(_heads(spark, sf_dir).select("interchange_id", "segments", "error"))
    return Wr.write_text(rows).select(_key("order_key"), "content", "n_segments")


@query("SELECT o_orderkey AS order_key, 'DTM+137:' || strftime(o_orderdate, '%Y%m%d') || ':102''' AS content FROM orders")
def mapped_to_text(spark, sf_dir):
    """Segment to struct and struct to segment by one declaration."""
    spec = M.Segment("DTM", (M.Field("day", 0, 1, type="date"), M.Field("format", 0, 2)), qualifier="137")
    value = spec.read(A.find_first(_segs(), "DTM"))
    return _heads(spark, sf_dir).select(_key("order_key"), spec.write(value).alias("content"))


@query("SELECT o_orderkey AS order_key, 'RFF+ON:' || o_orderkey || '+a?+b:c''' AS content FROM orders")
def raw_segments(spark, sf_dir):
    parts = F.array(F.concat(F.lit("ON:"), F.col("o_orderkey").cast("string")), F.lit("a+b:c"))
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_key"), Wr.raw_segment("RFF", parts).alias("content"))


@query("""WITH l AS (SELECT o_orderkey, length(CAST(o_orderkey AS VARCHAR)) AS k, length(CAST(o_custkey AS VARCHAR)) AS c FROM orders)
SELECT o_orderkey AS order_key, CAST(0 AS BIGINT) AS unh_start, CAST(21 + k AS BIGINT) AS bgm_start, CAST(21 + k + 11 + k AS BIGINT) AS dtm_start, CAST(21 + k + 11 + k + 8 AS BIGINT) AS date_start, CAST(21 + k + 11 + k + 21 AS BIGINT) AS dtm_end FROM l""")
def byte_spans(spark, sf_dir):
    p = parse(B.header_messages(spark, sf_dir), spans=True)
    unh, bgm, dtm = (A.find_first(_segs(), t) for t in ("UNH", "BGM", "DTM"))
    return p.select(_key("order_key"), unh["span"]["start"].alias("unh_start"), bgm["tag_span"]["start"].alias("bgm_start"), dtm["span"]["start"].alias("dtm_start"), A.component_span(dtm, 0, 1)["start"].alias("date_start"), dtm["span"]["end"].alias("dtm_end"))


@query("SELECT o_orderkey AS order_key, [CAST(137 AS VARCHAR), strftime(o_orderdate, '%Y%m%d')][1] AS a, strftime(o_orderdate, '%Y%m%d') AS b, 'E021' AS missing, 'E008' AS absent, CAST(NULL AS VARCHAR) AS none FROM orders")
def component_access(spark, sf_dir):
    dtm = A.find_first(_segs(), "DTM")
    two = A.repeating_components(dtm, 0, 0, 2)["value"]
    return _heads(spark, sf_dir).select(_key("order_key"), F.get(two, F.lit(0)).alias("a"), F.get(two, F.lit(1)).alias("b"), A.repeating_components(dtm, 0, 2, 2)["error"]["code"].alias("missing"), A.required_element(dtm, 4)["error"]["code"].alias("absent"), A.optional(dtm, 0, 9).alias("none"))


@query("SELECT o_orderkey AS order_key, o_custkey AS number, 'E003' AS code FROM orders")
def code_elements(spark, sf_dir):
    unt, unh = A.find_first(_segs(), "UNT"), A.find_first(_segs(), "UNH")
    return _heads(spark, sf_dir).select(_key("order_key"), A.component(A.find_first(_segs(), "NAD"), 1).cast("long").alias("number"), F.coalesce(A.code_element(unt, 0, "int")["error"], A.code_element(unh, 1, "int")["error"])["code"].alias("code"))


def _priority_messages(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    code = F.col("o_orderpriority")
    body = F.concat(B.head(key), Wr.segment_text("BGM", [code, key]), B.trailer(F.lit(3), key))
    return V.as_messages(parse(o.select(key.cast("string").alias("interchange_id"), body.alias("content")), chars=DEFAULT))


def _elements(n: int, *mandatory: int) -> tuple:
    return tuple(V.ElementRef(i + 1, i in mandatory) for i in range(n))


@query("""SELECT o_orderkey AS order_key, 'E014' AS error_code, 'warning' AS severity, 'BGM' AS segment_tag,
'segment BGM element 0: ''' || o_orderpriority || ''' is not a valid code (code list 1001)' AS message FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def code_list_violations(spark, sf_dir):
    d = V.DirectoryValidator("D11A", (V.SegmentDefinition("BGM", _elements(3, 0)),), {"1001": ("1-URGENT", "2-HIGH")}).code_list_only()
    out = V.ValidationContext().with_validator("code_list", d).validate(_priority_messages(spark, sf_dir))
    return out.select(_key("order_key"), "error_code", "severity", "segment_tag", "message")


def _faulty(spark, sf_dir):
    """Messages with faults by the order key's remainder by 11: 0 no BGM, 1 BGM after DTM, 2 short DTM, 3 extra element, 4 no document number, 5 unknown tag."""
    o = B.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    k = key % 11
    bgm = Wr.segment_text("BGM", [F.lit("220"), F.when(k != 4, key), F.lit("9")])
    long_ = Wr.segment_text("BGM", [F.lit("220"), key, F.lit("9"), F.lit("x")])
    dtm = F.when(k == 2, Wr.segment_text("DTM", [[F.lit("137"), F.lit("20260101")]])).otherwise(Wr.segment_text("DTM", [[F.lit("137"), F.lit("20260101"), F.lit("102")]]))
    extra = F.when(k == 5, F.lit("ZZZ+1'")).otherwise("")
    unh, unt = B.head(key), B.trailer(F.lit(4), key)
    body = F.when(k == 0, F.concat(unh, dtm, unt)).when(k == 1, F.concat(bgm, unh, dtm, unt)).when(k == 3, F.concat(unh, long_, dtm, unt)).otherwise(F.concat(unh, bgm, dtm, extra, unt))
    return V.as_messages(parse(o.select(key.cast("string").alias("interchange_id"), body.alias("content")), chars=DEFAULT))


DIRECTORY = V.DirectoryValidator(
    "D11A",
    (
        V.SegmentDefinition("UNH", _elements(2, 0, 1)),
        V.SegmentDefinition("BGM", _elements(3, 0, 1)),
        V.SegmentDefinition("DTM", _elements(1, 0), components={0: 3}),
        V.SegmentDefinition("UNT", _elements(2, 0, 1)),
    ),
).enforce_known_tags()
FAULTS = """WITH f AS (SELECT o_orderkey AS order_key, o_orderkey % 11 AS k FROM orders WHERE o_orderkey % 11 < 6)
SELECT order_key, CASE k WHEN 2 THEN 'E013' WHEN 3 THEN 'E012' WHEN 4 THEN 'E008' WHEN 5 THEN 'E011' END AS error_code,
CASE k WHEN 0 THEN 'required segment BGM missing for message type ORDERS'
WHEN 1 THEN 'segment sequence violation for message type ORDERS: ''BGM'' appears out of order'
WHEN 2 THEN 'segment DTM element 0 has 2 components, expected 3' WHEN 3 THEN 'segment BGM has 4 elements, expected between 2 and 3'
WHEN 4 THEN 'missing required element 1 in segment BGM' WHEN 5 THEN 'segment ZZZ is not valid for message type D11A' END AS message,
CASE k WHEN 0 THEN 'Add the mandatory segment at the correct position' WHEN 1 THEN 'Ensure required segments follow UN/EDIFACT canonical order'
WHEN 2 THEN 'Fix composite element arity to match the expected component count' WHEN 3 THEN 'Adjust the segment element count to the allowed min/max range'
WHEN 4 THEN 'Provide all mandatory elements for the segment per directory rules' WHEN 5 THEN 'Remove unsupported segment or switch to the correct message type' END AS suggestion,
CASE k WHEN 2 THEN 0 WHEN 4 THEN 1 END AS element_index FROM f"""


def _directory_issues(spark, sf_dir):
    return V.ValidationContext().with_validator("structure", DIRECTORY).validate(_faulty(spark, sf_dir))


@query(FAULTS)
def directory_issues(spark, sf_dir):
    return _directory_issues(spark, sf_dir).select(_key("order_key"), "error_code", "message", "suggestion", "element_index")


def _filtered(which: int) -> str:
    return f"SELECT order_key, message FROM ({FAULTS}) WHERE order_key % 11 = {which}"


@query(_filtered(0))
def required_segment_missing(spark, sf_dir):
    return _directory_issues(spark, sf_dir).where(F.col("message").startswith("required segment")).select(_key("order_key"), "message")


@query(_filtered(3))
def arity_violations(spark, sf_dir):
    return _directory_issues(spark, sf_dir).where("error_code = 'E012'").select(_key("order_key"), "message")


@query(_filtered(2))
def component_count_violations(spark, sf_dir):
    return _directory_issues(spark, sf_dir).where("error_code = 'E013'").select(_key("order_key"), "message")


def _pack() -> V.RulePack:
    def odd(segments):
        key = A.component(A.find_first(segments, "BGM"), 1).cast("long")
        return F.when(key % 5 == 0, V.issue("error", F.concat(F.lit("order "), key.cast("string"), F.lit(" is a multiple of five")), rule_id="KEY-P001", segment_tag="BGM", element_index=1))

    def buyer(segments):
        party = A.component(A.find_first(segments, "NAD", "BY"), 1).cast("long")
        return F.when(party % 3 == 0, V.issue("warning", "reserved buyer", rule_id="KEY-P002", segment_tag="NAD", element_index=1, suggestion="Use another buyer"))

    def always(_):
        return V.issue("info", "seen", rule_id="LOG-I001")

    return V.RulePack("demo").for_message_type("ORDERS").with_rule(odd).with_rule(buyer).merge(V.RulePack("log").for_message_type("INVOIC").with_rule(always))


PACKED = """(SELECT o_orderkey AS order_key, 'error' AS severity, 'KEY-P001' AS rule_id, 'order ' || o_orderkey || ' is a multiple of five' AS message FROM orders WHERE o_orderkey % 5 = 0
UNION ALL SELECT o_orderkey, 'warning', 'KEY-P002', 'reserved buyer' FROM orders WHERE o_custkey % 3 = 0
UNION ALL SELECT o_orderkey, 'info', 'LOG-I001', 'seen' FROM orders)"""


def _pack_issues(spark, sf_dir):
    rows = V.as_messages(_heads(spark, sf_dir).select("interchange_id", "segments", "error"))
    other = V.RulePack("other").for_message_type("DESADV").with_rule(lambda _: V.issue("error", "never"))
    return V.ValidationContext().with_pack(_pack()).with_pack(other).validate(rows)


@query(f"SELECT order_key, severity, rule_id, message FROM {PACKED}")
def profile_pack_issues(spark, sf_dir):
    return _pack_issues(spark, sf_dir).select(_key("order_key"), "severity", "rule_id", "message")


@query(f"SELECT order_key, rule_id FROM {PACKED} WHERE starts_with(rule_id, 'KEY-')")
def rule_prefix_filter(spark, sf_dir):
    return R.of_rule_prefix(_pack_issues(spark, sf_dir), "KEY-").select(_key("order_key"), "rule_id")


@query(f"SELECT order_key, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) AS total_issues, count(*) FILTER (severity = 'error') = 0 AS is_valid FROM {PACKED} GROUP BY 1")
def report_severity_counts(spark, sf_dir):
    return R.counts(_pack_issues(spark, sf_dir), "interchange_id").select(_key("order_key"), "errors", "warnings", "infos", "total_issues", "is_valid")


@query("""SELECT o_orderkey AS order_key, 'Validation Report:' ||
CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || '  Errors (1)' || chr(10) || '    - order ' || o_orderkey || ' is a multiple of five [segment=BGM] [rule=KEY-P001] [element=1]' ELSE '' END ||
CASE WHEN o_custkey % 3 = 0 THEN chr(10) || '  Warnings (1)' || chr(10) || '    - reserved buyer [segment=NAD] [rule=KEY-P002] [element=1] [hint=Use another buyer]' ELSE '' END ||
chr(10) || '  Info (1)' || chr(10) || '    - seen [rule=LOG-I001]' AS report FROM orders""")
def report_text(spark, sf_dir):
    return R.render(_pack_issues(spark, sf_dir), "interchange_id").select(_key("order_key"), "report")


@query("""SELECT o_orderkey AS order_key, CASE o_orderkey % 8 WHEN 0 THEN 'E001' WHEN 1 THEN 'E019' WHEN 2 THEN 'E006' WHEN 3 THEN 'E002' WHEN 4 THEN 'E007' WHEN 5 THEN 'E020' END AS code,
CAST(CASE o_orderkey % 8 WHEN 4 THEN 0 ELSE 1 END AS BIGINT) AS n_segments FROM orders""")
def parse_error_codes(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    k = key % 8
    tail = F.when(k == 0, "BGM+2").when(k == 1, "BGM+2?").when(k == 2, "bgm+2'").when(k == 3, "+2'").when(k == 5, F.lit("FTX+" + "x" * 200 + "'")).otherwise("")
    body = F.concat(F.when(k == 4, "UNA++.? '").otherwise(""), Wr.segment_text("UNH", [key]), tail)
    p = parse(o.select(key.cast("string").alias("interchange_id"), body.alias("content")), max_segment_bytes=150)
    return p.select(_key("order_key"), F.col("error.code").alias("code"), F.size("segments").cast("long").alias("n_segments"))


@query("""SELECT n_name AS nation, count(*) AS n_lines, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS cents
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1""")
def invoice_value_by_supplier_nation(spark, sf_dir):
    """INVOIC messages by line, parsed, joined with the relational tables and summed."""
    li = B.table(spark, sf_dir, "lineitem")
    ref = F.col("l_orderkey")
    body = F.concat(
        B.head(ref, "INVOIC"),
        Wr.segment_text("BGM", [F.lit("380"), ref]),
        Wr.segment_text("NAD", [F.lit("SU"), F.col("l_suppkey")]),
        Wr.segment_text("MOA", [[F.lit("203"), F.round(F.col("l_extendedprice") * 100).cast("long"), F.lit("CNT")]]),
        B.trailer(F.lit(5), ref),
    )
    p = parse(li.select(body.alias("content")), chars=DEFAULT)
    got = p.select(A.component(A.find_first(_segs(), "NAD", "SU"), 1).cast("long").alias("s_suppkey"), A.component(A.find_first(_segs(), "MOA", "203"), 0, 1).cast("long").alias("cents"))
    got = got.groupBy("s_suppkey").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"))
    s, n = B.table(spark, sf_dir, "supplier"), B.table(spark, sf_dir, "nation")
    both = got.join(s, "s_suppkey").join(n, s["s_nationkey"] == n["n_nationkey"])
    return both.groupBy(F.col("n_name").alias("nation")).agg(F.sum("n").alias("n_lines"), F.sum("cents").alias("cents"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y%m%d%H') AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_stream_windows(spark, sf_dir):
    """Batch twin of the stream: one message an event, windowed by the parsed time."""
    e = B.table(spark, sf_dir, "events")
    key = F.col("event_id")
    body = F.concat(B.head(key, "EVENTS"), Wr.segment_text("DTM", [[F.lit("137"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit("204")]]), Wr.segment_text("EVT", [F.col("event_type")]), B.trailer(F.lit(4), key))
    p = parse(e.select(body.alias("content")), chars=DEFAULT)
    at = F.substring(A.component(A.find_first(_segs(), "DTM"), 0, 1), 1, 10)
    return p.groupBy(at.alias("hour"), A.component(A.find_first(_segs(), "EVT"), 0).alias("event_type")).agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS order_key, CASE o_orderkey % 7 WHEN 0 THEN 'E015' WHEN 1 THEN 'E015' WHEN 2 THEN 'E016' WHEN 3 THEN 'E003' WHEN 4 THEN 'E004' WHEN 5 THEN 'E011' END AS code FROM orders""")
def envelope_errors(spark, sf_dir):
    """Faults of the interchange by the order key's remainder by 7, each with its first error."""
    o = B.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    k = key % 7
    unb = Wr.segment_text("UNB", [[F.lit("UNOC"), F.lit("3")], F.lit("S"), F.lit("R"), [F.lit("260101"), F.lit("1200")], key])
    unz = Wr.segment_text("UNZ", [F.when(k == 3, F.lit("x")).when(k == 4, F.lit("2")).otherwise(F.lit("1")), F.when(k == 2, key + 1).otherwise(key)])
    msg = F.concat(B.head(key), B.trailer(F.lit(2), key))
    body = F.concat(F.when(k == 0, "").otherwise(unb), msg, F.when(k == 5, "DTM+1'").otherwise(""), F.when(k == 1, "").otherwise(unz))
    return envelopes(parse(o.select(key.cast("string").alias("interchange_id"), body.alias("content")), chars=DEFAULT)).select(_key("order_key"), F.col("error.code").alias("code"))


from tradewire.plans import checks  # noqa: E402, F401  registers its queries
