"""Reports over the issues table: counts, filters and the fixed text form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = (("errors", "Errors", ("critical", "error")), ("warnings", "Warnings", ("warning",)), ("infos", "Info", ("info",)))


def bucket() -> Column:
    """0 for errors, 1 for warnings, 2 for infos."""
    return F.when(F.col("severity").isin("critical", "error"), 0).when(F.col("severity") == "warning", 1).otherwise(2)


def counts(issues: DataFrame, *by: str) -> DataFrame:
    """Errors, warnings, infos, total and is_valid of each group that has issues."""
    n = [F.count_if(F.col("severity").isin(*levels)).alias(name) for name, _, levels in BUCKETS]
    return issues.groupBy(*by).agg(*n, F.count("*").alias("total_issues"), (F.count_if(F.col("severity").isin("critical", "error")) == 0).alias("is_valid"))


def counts_of_all(messages: DataFrame, issues: DataFrame, *by: str) -> DataFrame:
    """``counts`` with a row for each of ``messages``: one without issues has none and is valid."""
    found = messages.select(*by).join(counts(issues, *by), list(by), "left")
    zero = {n: F.coalesce(n, F.lit(0)) for n in (*(name for name, *_ in BUCKETS), "total_issues")}
    return found.withColumns(zero | {"is_valid": F.coalesce("is_valid", F.lit(True))})


def in_order(issues: DataFrame, *by: str) -> DataFrame:
    """All issues: errors, then warnings, then infos, as added."""
    return issues.orderBy(*by, bucket(), "ordinal")


def of_rule(issues: DataFrame, rule_id: str) -> DataFrame:
    return issues.where(F.col("rule_id") == rule_id)


def of_rule_prefix(issues: DataFrame, prefix: str) -> DataFrame:
    return issues.where(F.col("rule_id").startswith(prefix))


def display() -> Column:
    """[LABEL] message."""
    return F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("message"))


def _line() -> Column:
    tagged = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f" [{name}" + ("=" if name else "")), F.col(c).cast("string"), F.lit("]"))).otherwise("")
    return F.concat(F.lit("    - "), "message", tagged("", "error_code"), tagged("segment", "segment_tag"), tagged("rule", "rule_id"), tagged("element", "element_index"), tagged("component", "component_index"), tagged("offset", "offset"), tagged("hint", "suggestion"))


def render(issues: DataFrame, *by: str) -> DataFrame:
    """(by…, report): the fixed text, sorted within each bucket by place, tag, rule, code and message."""
    key = F.struct(
        F.coalesce("offset", F.lit(2**63 - 1)).alias("a"),
        F.coalesce("segment_tag", F.lit("")).alias("b"),
        F.coalesce("rule_id", F.lit("")).alias("c"),
        F.coalesce("element_index", F.lit(255)).alias("d"),
        F.coalesce("component_index", F.lit(255)).alias("e"),
        F.coalesce("error_code", F.lit("")).alias("f"),
        F.col("message").alias("g"),
        _line().alias("line"),
    )
    rows = issues.select(*by, bucket().alias("__b"), key.alias("__k"))
    rows = rows.groupBy(*by).agg(*[F.array_sort(F.collect_list(F.when(F.col("__b") == i, F.col("__k")))).alias(name) for i, (name, _, _) in enumerate(BUCKETS)])
    text = F.lit("Validation Report:")
    for name, title, _ in BUCKETS:
        lines = F.array_join(F.transform(name, lambda x: x["line"]), "\n")
        text = F.concat(text, F.when(F.size(name) > 0, F.concat(F.lit(f"\n  {title} ("), F.size(name).cast("string"), F.lit(")\n"), lines)).otherwise(""))
    return rows.select(*by, text.alias("report"))
