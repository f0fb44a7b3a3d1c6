"""The evidence table: append, read, count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import rounded

DIRECTIONS = ("input", "output")
OWASP_FINDINGS = "array<struct<category_id:string,category_name:string,risk_score:double,compliant:boolean>>"
EU_FINDINGS = "array<struct<article:string,title:string,compliant:boolean,compliance_score:double,risk_level:string>>"


def _found(findings: Column | None, kind: str) -> Column:
    return F.lit(None).cast(kind) if findings is None else F.when(F.size(findings) > 0, findings.cast(kind))


def records(df: DataFrame, results: str = "check_results", direction: str = "input", session: str | None = None, ts: Column | None = None, meta: str | None = None, owasp: Column | None = None, eu: Column | None = None) -> DataFrame:
    """Evidence rows of check results: id, session_id, timestamp, direction, risk_score, passed, checks, findings, meta and the partition dt.

    ``owasp`` and ``eu`` are each row's own findings (``compliance.row_owasp``, ``row_eu``); without any they are null.
    """
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    r = F.col(results)
    when = ts if ts is not None else F.current_timestamp()
    return df.select(
        F.uuid().alias("id"),
        (F.coalesce(F.col(session).cast("string"), F.uuid()) if session else F.uuid()).alias("session_id"),
        when.alias("timestamp"),
        F.lit(direction).alias("direction"),
        F.coalesce(F.array_max(F.transform(r, lambda x: x["score"])), F.lit(0.0)).alias("risk_score"),
        F.forall(r, lambda x: x["passed"]).alias("passed"),
        r.alias("checks"),
        _found(owasp, OWASP_FINDINGS).alias("owasp_findings"),
        _found(eu, EU_FINDINGS).alias("eu_findings"),
        (F.col(meta) if meta else F.lit("{}")).alias("meta"),
        F.to_date(when).alias("dt"),
    )


def append(rows: DataFrame, path: str) -> None:
    """Partitioned by day, so that later reads prune; rows of a day land in as many files as tasks hold any."""
    rows.write.mode("append").partitionBy("dt").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    """All rows; parts that were written before a column was added have nulls in it."""
    return spark.read.option("mergeSchema", True).parquet(path)


def query(evidence: DataFrame, session_id: str | None = None, failed_only: bool = False, limit: int = 100) -> DataFrame:
    """Latest first, at most ``limit`` rows (1 to 10,000): a top-k, not a sort."""
    out = evidence
    if session_id:
        out = out.where(F.col("session_id") == session_id)
    if failed_only:
        out = out.where("not passed")
    return out.orderBy(F.col("timestamp").desc(), "id").limit(max(1, min(limit, 10_000)))


def stats(evidence: DataFrame) -> DataFrame:
    total, failed = F.count("*"), F.count_if(~F.col("passed"))
    rate = F.when(total == 0, 100.0).otherwise(rounded((total - failed) / F.nullif(total, F.lit(0)) * 100, 1))
    return evidence.agg(total.alias("total"), failed.alias("failed"), rate.alias("pass_rate"), F.coalesce(rounded(F.avg("risk_score"), 3), F.lit(0.0)).alias("avg_risk_score"))


#: Rows that a page is looked for in at most when it is told by an offset.
DEEPEST = 100_000


def page(evidence: DataFrame, offset: int = 0, limit: int = 50, failed_only: bool = False, after: tuple | None = None) -> DataFrame:
    """Latest first. ``after``: (timestamp, id) of the last row seen, from which a page costs the same at any depth; an offset is sorted through, so it has a bound."""
    if not 0 <= offset <= DEEPEST:
        raise ValueError(f"offset must be from 0 to {DEEPEST}; go on by after=(timestamp, id)")
    out = evidence.where("not passed") if failed_only else evidence
    if after:
        ts, key = F.lit(after[0]), F.lit(after[1])
        out = out.where((F.col("timestamp") < ts) | ((F.col("timestamp") == ts) & (F.col("id") > key)))
    return out.orderBy(F.col("timestamp").desc(), "id").offset(offset).limit(max(1, min(limit, 10_000)))


def sessions_with_failures(evidence: DataFrame) -> DataFrame:
    bad = evidence.where("not passed").select("session_id").distinct()
    return evidence.join(bad, "session_id", "left_semi")


def rollup(evidence: DataFrame) -> DataFrame:
    """Counts by direction and check, with subtotals."""
    each = evidence.select("direction", F.explode_outer("checks").alias("c")).where("c is not null")
    return each.rollup("direction", F.col("c.check_name").alias("check_name")).agg(F.count("*").alias("n"), F.count_if(~F.col("c.passed")).alias("failed"), F.max("c.score").alias("top_score"))


def append_stream(rows: DataFrame, path: str, checkpoint: str, available_now: bool = False):
    """The same append for a stream of evidence rows: exactly once for each micro-batch. Returns the started query."""
    writer = rows.writeStream.format("parquet").outputMode("append").partitionBy("dt").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
