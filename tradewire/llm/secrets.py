"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Candidates are found in whole texts; their value hashes are aggregated over the corpus by
distinct repositories and owners. A document's copies are not ownership: each distinct text counts
for one owner and one repository, its least. A value is a widely copied example only if more than
``max_owners`` owners hold it and its distinct texts count for several owners and several
repositories; any other is live-looking. Near copies are distinct texts. The base kinds (assign, access, hex)
are reported whatever the verdict; the kind ``owned`` is added by the method: long mixed strings
without a known form which are live-looking and overlap no base span.

Positions come from the pieces between the matches: ``split`` and ``regexp_extract_all`` walk a
text by the same leftmost, non-overlapping matches, so running sums of their lengths give each
match's place in code points without any Python.

Defined cases: a null text is the empty text; null owners or repositories count as one unnamed
owner or repository; repeated rows are scanned each and count as one repository; rows without
candidates are returned with zero counts; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tradewire.llm.common import scratch

# The patterns of the base kinds.
ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of these forms is greedy, so a least length in the pattern drops the same matches as a later filter.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
OWNED = "[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
PATTERNS = dict(zip(KINDS, (ASSIGN, ACCESS, HEX, OWNED), strict=True))


@dataclass
class Scan:
    """documents: a row for each input row; spans: a row for each reported span, with its verdict."""

    documents: DataFrame
    spans: DataFrame


def _found(text: Column, kind: str) -> Column:
    """array of (gap before, match); the last element has no match."""
    pattern = F.lit(PATTERNS[kind])
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    both = F.arrays_zip(gaps.alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"))
    both = F.transform(both, lambda x: F.struct(x["gap"].alias("gap"), x["match"].alias("match")))
    return F.when(text.rlike(PATTERNS[kind]), both)


def scan(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source", max_owners: int = 4) -> Scan:
    body = F.coalesce(F.col(text), F.lit(""))
    rows = scratch(
        df.select(
            F.col(doc_id).alias("doc_id"),
            F.coalesce(F.col(repository).cast("string"), F.lit("")).alias("repository"),
            F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"),
            F.xxhash64(body).alias("text_hash"),
            *[_found(body, k).alias(k) for k in KINDS],
        ).withColumn("uid", F.monotonically_increasing_id())
    )
    parts = []
    for rank, kind in enumerate(KINDS):
        one = rows.where(F.col(kind).isNotNull()).select("uid", "doc_id", "text_hash", "repository", "owner", F.posexplode(kind).alias("pos", "x"))
        parts.append(one.select("uid", "doc_id", "text_hash", "repository", "owner", F.lit(rank).alias("rank"), "pos", F.col("x.gap").alias("gap"), F.col("x.match").alias("match")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    before = W.partitionBy("uid", "rank").orderBy("pos")
    size = F.coalesce(F.length("match"), F.lit(0))
    end = F.sum(F.col("gap") + size).over(before.rowsBetween(W.unboundedPreceding, 0))
    value = F.when(F.col("rank") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    found = found.withColumns({"end": end, "value": value}).where(F.col("match").isNotNull())
    found = found.withColumn("start", F.col("end") - F.length("match"))
    mixed = (F.length(F.regexp_replace("value", "[^0-9]+", "")) >= 2) & F.col("value").rlike("[A-Za-z]")
    found = found.where(F.when(F.col("rank") == 0, F.length("value") >= 12).when(F.col("rank") == 3, mixed).otherwise(True))

    # An added span must not overlap a base one.
    line = W.partitionBy("uid").orderBy("start", "rank", "end")
    base = F.col("rank") < 3
    last = F.max(F.when(base, F.col("end"))).over(line.rowsBetween(W.unboundedPreceding, -1))
    following = F.min(F.when(base, F.col("start"))).over(line.rowsBetween(1, W.unboundedFollowing))
    clear = (F.coalesce(last, F.lit(0)) <= F.col("start")) & (F.coalesce(following, F.col("end")) >= F.col("end"))
    found = found.withColumn("clear", clear).where(base | F.col("clear"))
    found = scratch(found.select("uid", "doc_id", "text_hash", "repository", "owner", "rank", "start", "end", F.sha2("value", 256).alias("value_hash")))

    # A hot value is spread by its texts first; later sums combine before they are dealt out.
    owners = found.groupBy("value_hash", "owner").agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias("n_owners"))
    held = found.groupBy("value_hash", "text_hash").agg(F.min("owner").alias("owner"), F.min("repository").alias("repository"))
    several = [held.groupBy("value_hash", c).agg(F.count("*").alias("n")).groupBy("value_hash").agg(F.count("*").alias(n)) for c, n in (("owner", "n_sources"), ("repository", "n_repositories"))]
    stats = owners.join(several[0], "value_hash").join(several[1], "value_hash")
    copied = (F.col("n_owners") > max_owners) & (F.col("n_sources") > 1) & (F.col("n_repositories") > 1)
    spans = found.join(stats, "value_hash").withColumn("live", ~copied)
    spans = spans.where((F.col("rank") < 3) | F.col("live")).withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("rank") + 1))

    def joined(which: Column) -> Column:
        mine = F.sort_array(F.collect_list(F.when(which, F.struct("start", "rank", "kind", "end"))))
        return F.array_join(F.transform(mine, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    count = lambda w: F.count(F.when(w, 1))
    each = spans.groupBy("uid").agg(
        *[count(F.col("rank") == i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(joined(F.col("rank") < 3), 256).alias("base_sha256"),
        joined(F.lit(True)).alias("spans"),
        count(F.col("live")).alias("n_live"),
        count(~F.col("live")).alias("n_copied"),
        F.coalesce(F.max("n_owners"), F.lit(0)).alias("most_owners"),
    )
    out = rows.select("uid", "doc_id").join(each, "uid", "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")) for c in (*(f"n_{k}" for k in KINDS), "n_live", "n_copied", "most_owners")}
    out = out.withColumns(zero | {"base_sha256": F.coalesce("base_sha256", F.sha2(F.lit(""), 256)), "spans": F.coalesce("spans", F.lit(""))})
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_owned", "n_live", "n_copied", "most_owners"]
    return Scan(out.select(names), spans.select("doc_id", "text_hash", "kind", "start", "end", "value_hash", "n_repositories", "n_owners", "live"))


def redact(df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", repository: str = "doc_id", owner: str = "source", max_owners: int = 4, mask: str = "[SECRET]") -> DataFrame:
    """``df`` with every live-looking span replaced by ``mask``; widely copied examples stay."""
    found = scan(df, doc_id=doc_id, text=text, repository=repository, owner=owner, max_owners=max_owners).spans
    found = found.where("live").select("doc_id", "text_hash", "start", "end").distinct()
    # Overlapping spans become one: a new island starts where a span begins at or after all earlier ends.
    line = W.partitionBy("doc_id", "text_hash").orderBy("start", "end")
    opens = F.coalesce(F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    found = found.withColumn("island", F.sum(opens.cast("int")).over(line.rowsBetween(W.unboundedPreceding, 0)))
    found = found.groupBy("doc_id", "text_hash", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    found = found.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(doc_id).alias("its_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("its_hash"))
    # One plan at every size: what is found grows with the input, so it is never sent out whole.
    both = rows.join(found.hint("merge"), rows["its_id"].eqNullSafe(found["doc_id"]) & (rows["its_hash"] == found["text_hash"]), "left")
    body = F.col("row")[text]
    done = F.aggregate(
        "spans",
        F.struct(F.lit("").alias("text"), F.lit(0).cast("long").alias("at")),
        lambda a, s: F.struct(F.concat(a["text"], body.substr(a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(mask)).alias("text"), s["end"].cast("long").alias("at")),
        lambda a: F.concat(a["text"], body.substr(a["at"].cast("int") + 1, F.length(body))),
    )
    masked = F.when(F.col("spans").isNull(), body).otherwise(done)
    return both.select(*[masked.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns])


def op2(spark, sf_dir: str) -> DataFrame:
    """Secrets in all documents; a document stands for a repository, its source for the owner."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).documents

