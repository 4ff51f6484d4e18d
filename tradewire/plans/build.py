"""Interchanges built at query time from the relational tables; nothing is stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewire.functions.syntax import DEFAULT, ServiceChars
from tradewire.operators.writer import segment_text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def head(ref: Column, kind: str = "ORDERS", chars: ServiceChars = DEFAULT) -> Column:
    return segment_text("UNH", [ref, [F.lit(kind), F.lit("D"), F.lit("11A"), F.lit("UN")]], chars)


def trailer(count: Column, ref: Column, chars: ServiceChars = DEFAULT) -> Column:
    return segment_text("UNT", [count, ref], chars)


def order_head(chars: ServiceChars = DEFAULT) -> Column:
    """UNH, BGM, DTM and the buyer, from the columns of orders."""
    key = F.col("o_orderkey")
    return F.concat(
        head(key, chars=chars),
        segment_text("BGM", [F.lit("220"), key, F.lit("9")], chars),
        segment_text("DTM", [[F.lit("137"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("102")]], chars),
        segment_text("NAD", [F.lit("BY"), [F.col("o_custkey"), F.lit(""), F.lit("9")]], chars),
    )


def header_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(interchange_id, content, o_*): one message of five segments for each order, without its lines."""
    key = F.col("o_orderkey")
    body = F.concat(order_head(), trailer(F.lit(5), key))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", key.cast("string").alias("interchange_id"), body.alias("content"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, lines): the lines of each order as an array, in order of all their columns."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"))


def orders_with_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.join(order_lines(spark, sf_dir), orders["o_orderkey"] == F.col("l_orderkey"))


def line_text(x: Column, chars: ServiceChars = DEFAULT) -> Column:
    return F.concat(
        segment_text("LIN", [x["l_linenumber"], F.lit(""), [x["l_partkey"], F.lit("SRV")]], chars),
        segment_text("NAD", [F.lit("SU"), [x["l_suppkey"], F.lit(""), F.lit("9")]], chars),
        segment_text("QTY", [[F.lit("21"), x["l_quantity"].cast("long"), F.lit("PCE")]], chars),
    )


def order_messages(spark: SparkSession, sf_dir: str, chars: ServiceChars = DEFAULT, una: bool = False, drop_unt: Column | None = None, wrong_unt: Column | None = None, envelope: bool = False) -> DataFrame:
    """(interchange_id, content): one ORDERS message for each order with its lines."""
    key = F.col("o_orderkey")
    count = (F.lit(5) + 3 * F.size("lines")).cast("long")
    if wrong_unt is not None:
        count = F.when(wrong_unt, count + 1).otherwise(count)
    end = trailer(count, key, chars)
    if drop_unt is not None:
        end = F.when(drop_unt, F.lit("")).otherwise(end)
    body = F.concat(order_head(chars), F.array_join(F.transform("lines", lambda x: line_text(x, chars)), ""), end)
    if envelope:
        unb = segment_text("UNB", [[F.lit("UNOC"), F.lit("3")], F.lit("SENDER"), F.lit("RECEIVER"), [F.date_format("o_orderdate", "yyMMdd"), F.lit("1200")], key], chars)
        body = F.concat(unb, body, segment_text("UNZ", [F.lit(1), key], chars))
    if una:
        body = F.concat(F.lit(chars.una()), body)
    return orders_with_lines(spark, sf_dir).select(key.cast("string").alias("interchange_id"), body.alias("content"))


def text_messages(df: DataFrame, key: str, text: str) -> DataFrame:
    """(interchange_id, content): each row's text as one free-text component."""
    ref = F.col(key)
    body = F.concat(head(ref, "TEXTXT"), segment_text("FTX", [F.lit("AAI"), F.lit(""), F.lit(""), F.col(text)]), trailer(F.lit(3), ref))
    return df.select(ref.cast("string").alias("interchange_id"), body.alias("content"))
