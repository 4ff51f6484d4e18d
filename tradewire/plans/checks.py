"""Further registered queries: places of code rules, code tables, own service characters, byte counts, windows and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tradewire.functions import access as A
from tradewire.functions.syntax import DEFAULT, ServiceChars
from tradewire.operators import mapping as M
from tradewire.operators import report as R
from tradewire.operators import validate as V
from tradewire.operators import windows as Wn
from tradewire.operators import writer as Wr
from tradewire.operators.parse import parse, shifted
from tradewire.plans import build as B
from tradewire.plans import queries as Q
from tradewire.plans.queries import query
from tradewire.sources.edifact import split_interchanges

BACKSLASH = ServiceChars(component="|", element="!", decimal=",", release="\\", terminator="~")


def _content(spark, sf_dir, body):
    return B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("interchange_id"), body.alias("content"))


@query("""SELECT o_orderkey AS order_key, 'E014' AS error_code, 'segment DTM element 0: ''203'' is not a valid code (code list 2379)' AS message, 'Write dates as 102' AS suggestion
FROM orders WHERE o_orderkey % 3 = 0""")
def code_rule_positions(spark, sf_dir):
    """A code list on component (0, 2), with a hint for one value."""
    k = F.col("o_orderkey")
    dtm = Wr.segment_text("DTM", [[F.lit("137"), F.lit("20260101"), F.when(k % 3 == 0, "203").otherwise("102")]])
    d = V.DirectoryValidator("D11A", (V.SegmentDefinition("DTM", (V.ElementRef(1),)),), {"2379": ("102",)}, {"2379": {"203": "Write dates as 102"}}, {"DTM": ((0, 2, "2379"),)}).code_list_only()
    rows = V.as_messages(parse(_content(spark, sf_dir, F.concat(B.head(k), dtm, B.trailer(F.lit(3), k))), chars=DEFAULT))
    out = V.ValidationContext().with_validator("code_list", d).validate(rows)
    return out.select(Q._key("order_key"), "error_code", "message", "suggestion")


@query(Q.ORACLES["code_list_violations"].replace("'BGM' AS segment_tag", "'BGM' AS segment_tag, 'one of two' AS suggestion"))
def code_table_violations(spark, sf_dir):
    """The same list as a table of any size, with hints from a table."""
    o = B.table(spark, sf_dir, "orders").select(F.lit("1001").alias("data_element"), F.col("o_orderpriority").alias("code")).distinct()
    good = F.col("code").isin("1-URGENT", "2-HIGH")
    out = V.code_table_issues(Q._priority_messages(spark, sf_dir), o.where(good), {"BGM": "1001"}, o.where(~good).withColumn("suggestion", F.lit("one of two")))
    return out.select(Q._key("order_key"), "error_code", "severity", "segment_tag", "suggestion", "message")


@query("""SELECT o_custkey AS customer, o_orderkey AS number, CAST(o_orderdate AS DATE) AS ordered,
row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS message_no FROM orders""")
def typed_windows(spark, sf_dir):
    """Interchanges of several messages, each window mapped to a typed struct."""
    rows = B.header_messages(spark, sf_dir).groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "content"))).alias("m"))
    rows = rows.select(F.col("o_custkey").cast("string").alias("interchange_id"), F.array_join(F.transform("m", lambda x: x["content"]), "").alias("content"))
    spec = M.Message((M.Part("start", M.Segment("BGM", (M.Field("number", 1, 0, type="long", required=True),)), required=True), M.Part("dated", M.Segment("DTM", (M.Field("ordered", 0, 1, type="date", required=True),), qualifier="137"), required=True)))
    out = M.map_messages(Wn.messages(parse(rows, chars=DEFAULT)), spec)
    return out.select(Q._key("customer"), F.col("start.number").alias("number"), F.col("dated.ordered").alias("ordered"), F.col("message_no").cast("long").alias("message_no"))


@query("""SELECT l_orderkey AS order_key, l_linenumber AS line, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS plain, CAST(l_quantity AS BIGINT) || repeat('0', 20) AS large,
rtrim('0.' || lpad(CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), 20, '0'), '0') AS small, '-' || CAST(l_quantity AS BIGINT) || '.5' AS half FROM lineitem""")
def number_text(spark, sf_dir):
    """Doubles of any size as text without an exponent."""
    q = F.col("l_quantity").cast("double")
    return B.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"), Wr.as_text(q).alias("plain"), Wr.as_text(q * 1e20).alias("large"), Wr.as_text(q / 1e20).alias("small"), Wr.as_text(-q - 0.5).alias("half"))


@query("""WITH l AS (SELECT o_orderkey, length(CAST(o_orderkey AS VARCHAR)) AS k FROM orders)
SELECT o_orderkey AS order_key, CAST(21 + k + 8 AS BIGINT) AS number_start, CAST(21 + 2 * k + 8 AS BIGINT) AS number_end, CAST(121 + k AS BIGINT) AS moved FROM l""")
def element_spans(spark, sf_dir):
    """Spans of an element, and of segments moved as part of a larger text."""
    p = parse(B.header_messages(spark, sf_dir), spans=True)
    span = A.element_span(A.find_first(Q._segs(), "BGM"), 1)
    return p.select(Q._key("order_key"), span["start"].alias("number_start"), span["end"].alias("number_end"), A.find_first(shifted(Q._segs(), 100), "BGM")["span"]["start"].alias("moved"))


@query("""SELECT o_orderkey AS order_key, CASE o_orderkey % 3 WHEN 1 THEN 'E019' ELSE 'E001' END AS code, CAST(CASE o_orderkey % 3 WHEN 2 THEN 21 ELSE 20 END AS BIGINT) AS place, '!' AS element, '\\' AS release FROM orders""")
def own_release_character(spark, sf_dir):
    """Texts that end early under their own service characters."""
    k = F.col("o_orderkey") % 3
    body = F.concat(F.lit(BACKSLASH.una() + "BGM!1~DTM!2"), F.when(k == 1, "\\").when(k == 2, "?").otherwise(""))
    p = parse(_content(spark, sf_dir, body), service=True)
    return p.select(Q._key("order_key"), F.col("error.code").alias("code"), F.col("error.offset").alias("place"), "service.element", "service.release")


@query("""SELECT o_orderkey AS order_key, CASE WHEN o_orderkey % 40 >= 18 THEN 'E020' WHEN o_orderkey % 2 = 0 THEN 'E001' END AS code,
CAST(CASE WHEN o_orderkey % 40 >= 18 THEN 6 WHEN o_orderkey % 2 = 0 THEN 14 + 2 * (o_orderkey % 40) END AS BIGINT) AS place FROM orders""")
def bytes_not_characters(spark, sf_dir):
    """Limits and offsets count bytes: two for each of these letters."""
    k = F.col("o_orderkey")
    body = F.concat(F.lit("UNH+1'FTX+"), F.repeat(F.lit("é"), (k % 40).cast("int")), F.lit("'"), F.when(k % 2 == 0, "BGM").otherwise(""))
    p = parse(_content(spark, sf_dir, body), chars=DEFAULT, max_segment_bytes=40)
    return p.select(Q._key("order_key"), F.col("error.code").alias("code"), F.col("error.offset").alias("place"))


@query("""SELECT o_orderkey AS order_key, CAST(2 AS BIGINT) AS n_whole, CASE WHEN o_orderkey % 3 = 0 THEN 'E015' END AS code FROM orders""")
def split_by_interchange(spark, sf_dir):
    """Two interchanges a text, the second with its own characters, and for some a segment of none."""
    k = F.col("o_orderkey")
    one = lambda c: F.concat(Wr.segment_text("UNB", [k], c), B.head(k, chars=c), B.trailer(F.lit(2), k, c), Wr.segment_text("UNZ", [F.lit("1"), k], c))
    body = F.concat(one(DEFAULT), F.when(k % 3 == 0, "BGM+1'").otherwise(""), F.lit(BACKSLASH.una()), one(BACKSLASH))
    rows = split_interchanges(_content(spark, sf_dir, body)).withColumn("interchange_id", F.split("interchange_id", "#")[0])
    return rows.groupBy("interchange_id").agg(F.count_if(F.col("error").isNull()).alias("n_whole"), F.max("error.code").alias("code")).select(Q._key("order_key"), "n_whole", "code")


@query(Q.FAULTS.replace("SELECT order_key,", "SELECT order_key, 'structure' AS layer,", 1))
def validation_layers(spark, sf_dir):
    """The layer of each issue; a layer that is switched off gives none."""
    codes = V.DirectoryValidator("D", (V.SegmentDefinition("BGM", Q._elements(3)),), {"1001": ("x",)}).code_list_only()
    both = V.ValidationContext().with_validator("structure", Q.DIRECTORY).with_validator("code_list", codes).with_layer("code_list", False)
    return both.validate(Q._faulty(spark, sf_dir)).select(Q._key("order_key"), "layer", "error_code", "message", "suggestion", "element_index")


@query(f"""SELECT o_orderkey AS order_key, count(p.severity) FILTER (p.severity = 'error') AS errors, count(p.severity) AS total_issues, count(p.severity) FILTER (p.severity = 'error') = 0 AS is_valid
FROM orders o LEFT JOIN (SELECT * FROM {Q.PACKED} WHERE rule_id = 'KEY-P001') p ON p.order_key = o.o_orderkey GROUP BY 1""")
def report_of_all_messages(spark, sf_dir):
    """Counts of every message, also of those without an issue."""
    issues = R.of_rule(Q._pack_issues(spark, sf_dir), "KEY-P001")
    every = B.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("interchange_id"))
    return R.counts_of_all(every, issues, "interchange_id").select(Q._key("order_key"), "errors", "total_issues", "is_valid")
