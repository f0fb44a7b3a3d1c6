"""Roll-ups of verdicts into the OWASP LLM Top 10, EU AI Act and NIST AI RMF.

Verdicts are rows: seq (order of the checks' runs), check_name, passed, score, owasp_refs. All groups are
aggregated before they meet a dimension, so what is joined has as many rows as there are checks or
categories; no list of single verdicts is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import EU_ARTICLES, LIVE_EU, LIVE_OWASP, MATURITY, NIST_FUNCTIONS, OWASP
from ..functions.text import let, rounded

AUDIT_LOG = "Audit log with timestamps"


def verdicts(df: DataFrame, results: str, order: str | Column) -> DataFrame:
    """One row for each result of an array column: seq by the rows' ``order`` (a struct, where one column alone has ties) and the place in the array."""
    by = F.col(order) if isinstance(order, str) else order
    # The outer form: the inner one would put a filter on the array's size before it, and work every check out twice.
    rows = df.select(by.alias("o"), F.posexplode_outer(results).alias("k", "r"))
    return rows.where("r is not null").select(F.struct("o", "k").alias("seq"), "r.check_name", "r.passed", "r.score", "r.severity", "r.owasp_refs", "r.matched_patterns")


def grade(score: Column) -> Column:
    return F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 45, "D").otherwise("F")


def owasp_dimension(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OWASP, "category_id string, category_name string, weight double")


def owasp_findings(rows: DataFrame) -> DataFrame:
    """A row for each category that a verdict refers to: highest risk first, then the order of first mention."""
    each = rows.select("seq", "check_name", "passed", "score", F.posexplode("owasp_refs").alias("k", "category_id"))
    per = each.groupBy("category_id").agg(F.max("score").alias("top"), F.bool_and("passed").alias("compliant"), F.count("*").alias("n_results"), F.count_if(~F.col("passed")).alias("n_failed"), F.array_sort(F.collect_set("check_name")).alias("triggered_by"), F.min(F.struct("seq", "k")).alias("first"))
    meta = per.join(F.broadcast(owasp_dimension(rows.sparkSession)), "category_id", "left")
    risk = rounded(F.col("top") * F.coalesce("weight", F.lit(1.0)), 3)
    found = meta.select("category_id", F.coalesce("category_name", "category_id").alias("category_name"), "triggered_by", risk.alias("risk_score"), "compliant", "n_results", "n_failed", "first")
    return found.orderBy(F.col("risk_score").desc(), "first").drop("first")


def owasp_posture(findings: DataFrame) -> DataFrame:
    a = findings.agg(F.avg("risk_score").alias("r"), F.count_if("compliant").alias("compliant_categories"), F.count("*").alias("total_categories"), F.array_sort(F.collect_list(F.when(F.col("risk_score") >= 0.7, F.col("category_id")))).alias("high_risk_categories"))
    score = F.when(F.col("r").isNull(), 100.0).otherwise(rounded(F.greatest(F.lit(0.0), (F.lit(1.0) - F.col("r")) * 100), 1))
    return a.select(score.alias("score"), grade(score).alias("grade"), "compliant_categories", "total_categories", "high_risk_categories")


def _relevant(rows: DataFrame, dimension: list[tuple[str, list[str]]], mode: str) -> DataFrame:
    """key, top, total, mean, n, failed, names of each dimension row, and whether any verdict at all is critical.

    * takes all verdicts, named checks one verdict a name: the last (mode last), or all of them (mode worst). The verdicts
    are aggregated once, to a row for each check; the dimension meets these few rows in one join.
    """
    last = F.max_by(F.struct("score", "passed"), "seq").alias("last")
    per = rows.groupBy("check_name").agg(last, F.max("score").alias("top"), F.sum("score").alias("total"), F.count("*").alias("n"), F.count_if(~F.col("passed")).alias("failed"))
    pairs = [(k, "all" if c == "*" else "named", c) for k, checks in dimension for c in checks] + [(k, "any", "*") for k, _ in dimension]
    pairs = rows.sparkSession.createDataFrame(pairs, "key string, kind string, wanted string")
    both = per.join(F.broadcast(pairs), (F.col("kind") != "named") | (F.col("wanted") == F.col("check_name")))
    counts, one = F.col("kind") != "any", (F.col("kind") == "named") & F.lit(mode == "last")
    of = lambda name, single: F.when(counts, F.when(one, single).otherwise(F.col(name)))
    top, total = of("top", F.col("last.score")), of("total", F.col("last.score"))
    n, failed = of("n", F.lit(1).cast("long")), of("failed", (~F.col("last.passed")).cast("long"))
    names = F.array_sort(F.collect_set(F.when(counts, F.col("check_name"))))
    critical = F.bool_or(F.when(~counts, F.col("top") >= 0.8)).alias("any_critical")
    return both.groupBy("key").agg(F.max(top).alias("top"), F.sum(total).alias("total"), (F.sum(total) / F.sum(n)).alias("mean"), F.sum(n).alias("n"), F.sum(failed).alias("failed"), names.alias("names"), critical)


def eu_findings(rows: DataFrame, audit_log: bool = True, mode: str = "last") -> DataFrame:
    """All seven articles. ``mode``: last takes a named check's last verdict, worst all of them."""
    spark = rows.sparkSession
    articles = spark.createDataFrame([(k, a, t, e) for k, (a, t, e, _) in enumerate(EU_ARTICLES)], "ordinal int, key string, title string, needed array<string>")
    got = articles.join(_relevant(rows, [(a, c) for a, _, _, c in EU_ARTICLES], mode), "key", "left")
    names = F.coalesce("names", F.array().cast("array<string>"))
    logged = (F.col("key") == "Article 12") & F.lit(audit_log)
    closed = lambda g: F.exists(names, lambda c: F.contains(F.lower(g), F.replace(c, F.lit("_"), F.lit(" ")))) | (logged & (g == AUDIT_LOG))
    score = F.when(F.col("n").isNull(), 50.0).otherwise(rounded((F.lit(1.0) - F.col("top")) * 100, 1))
    collected = F.concat(F.when(logged, F.array(F.lit(AUDIT_LOG))).otherwise(F.array().cast("array<string>")), F.transform(names, lambda c: F.concat(c, F.lit(" scan results"))))
    level = F.when(score < 40, "critical").when(score < 60, "high").when(score < 80, "medium").otherwise("low")
    return got.select("ordinal", F.col("key").alias("article"), "title", (F.coalesce("failed", F.lit(1)) == 0).alias("compliant"), score.alias("compliance_score"), collected.alias("evidence_collected"), F.filter("needed", lambda g: ~closed(g)).alias("evidence_gaps"), names.alias("triggered_checks"), level.alias("risk_level")).orderBy("ordinal")


def eu_posture(findings: DataFrame) -> DataFrame:
    gaps = F.transform(F.array_sort(F.collect_list(F.when(F.col("risk_level").isin("critical", "high"), F.struct("ordinal", "article")))), lambda g: g["article"])
    a = findings.agg(F.avg("compliance_score").alias("mean"), F.count_if("compliant").alias("articles_compliant"), F.count("*").alias("total_articles"), gaps.alias("critical_gaps"))
    mean = F.coalesce("mean", F.lit(0.0))
    advice = F.when(F.col("mean") >= 75, "APPROVED").when(F.col("mean") >= 50, "CONDITIONAL").otherwise("NOT APPROVED")
    return a.select(rounded(mean, 1).alias("score"), F.when(F.col("mean").isNull(), "F").otherwise(grade(mean)).alias("grade"), "articles_compliant", "total_articles", "critical_gaps", advice.alias("deployment_recommendation"))


def nist_findings(rows: DataFrame, audit_log: bool = True, monitoring: bool = True, mode: str = "last", absent: bool = False) -> DataFrame:
    """``absent``: in the mean of last verdicts, a named check that never ran counts as one with score 0; else it is left out."""
    spark = rows.sparkSession
    functions = spark.createDataFrame([(k, f, s) for k, (f, s, _) in enumerate(NIST_FUNCTIONS)], "ordinal int, key string, subcategories array<string>")
    got = functions.join(_relevant(rows, [(f, c) for f, _, c in NIST_FUNCTIONS], mode), "key", "left").withColumn("any_critical", F.coalesce("any_critical", F.lit(False)))
    named = F.coalesce(*[F.when(F.col("key") == f, len(c)) for f, _, c in NIST_FUNCTIONS if "*" not in c])
    mean = F.coalesce(F.col("total") / named if absent and mode == "last" else F.lit(None), "mean", F.lit(0.0))
    kept = F.when(mean < 0.3, 3).otherwise(2) if audit_log and monitoring else F.when(mean < 0.2, 2).otherwise(1)
    level = F.when(F.col("n").isNull() | F.col("any_critical"), 1).when(mean > 0.5, 2).otherwise(kept)
    label = F.element_at(F.array(*[F.lit(MATURITY[k]) for k in sorted(MATURITY)]), level)
    sub = F.map_from_entries(F.transform("subcategories", lambda s: F.struct(s, rounded(F.greatest(F.lit(0.0), F.lit(1.0) - mean), 2))))
    advice = F.filter(
        F.array(
            F.when(level < 3, F.concat(F.lit("Reach maturity level 3 by continuous "), F.lower("key"), F.lit(" processes."))),
            F.lit(None if audit_log else "Switch the audit log on to track risk over time."),
            F.when(F.col("any_critical"), "Settle critical findings to leave the first level."),
        ),
        lambda x: x.isNotNull(),
    )
    return got.select("ordinal", F.col("key").alias("function"), level.alias("maturity_level"), label.alias("maturity_label"), sub.alias("subcategory_scores"), advice.alias("recommendations")).orderBy("ordinal")


def row_owasp(results: Column) -> Column:
    """One row's OWASP findings: array<struct<category_id, category_name, risk_score, compliant>>, highest risk first, then by first mention."""
    return let(results, _row_owasp)


def _row_owasp(results: Column) -> Column:
    names = F.create_map(*[F.lit(x) for i, n, _ in OWASP for x in (i, n)])
    weights = F.create_map(*[F.lit(x) for i, _, w in OWASP for x in (i, w)])

    def of(category: Column, place: Column) -> Column:
        mine = F.filter(results, lambda r: F.array_contains(r["owasp_refs"], category))
        risk = rounded(F.array_max(F.transform(mine, lambda r: r["score"])) * F.coalesce(weights[category], F.lit(1.0)), 3)
        return F.struct((-risk).alias("minus"), place.alias("place"), category.alias("category_id"), F.forall(mine, lambda r: r["passed"]).alias("compliant"))

    ranked = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform(results, lambda r: r["owasp_refs"]))), of))
    return F.transform(ranked, lambda x: F.struct(x["category_id"].alias("category_id"), F.coalesce(names[x["category_id"]], x["category_id"]).alias("category_name"), F.abs(x["minus"]).alias("risk_score"), x["compliant"].alias("compliant")))


def row_eu(results: Column) -> Column:
    """One row's findings for all seven articles: array<struct<article, title, compliant, compliance_score, risk_level>>; named checks by their last verdict."""
    return let(results, _row_eu)


def _row_eu(results: Column) -> Column:
    def of(article: str, title: str, checks: list[str]) -> Column:
        if "*" in checks:
            mine = results
        else:
            named = lambda c: F.filter(results, lambda r: r["check_name"] == c)
            mine = F.filter(F.array(*[F.try_element_at(named(c), F.lit(-1)) for c in checks]), lambda r: r.isNotNull())
        top = F.array_max(F.transform(mine, lambda r: r["score"]))
        score = F.when(F.size(mine) == 0, 50.0).otherwise(rounded((F.lit(1.0) - top) * 100, 1))
        level = F.when(score < 40, "critical").when(score < 60, "high").when(score < 80, "medium").otherwise("low")
        return F.struct(F.lit(article).alias("article"), F.lit(title).alias("title"), ((F.size(mine) > 0) & F.forall(mine, lambda r: r["passed"])).alias("compliant"), score.alias("compliance_score"), level.alias("risk_level"))

    return F.array(*[of(a, t, checks) for a, t, _, checks in EU_ARTICLES])


def blocked_rollup(guarded: DataFrame, guard: str = "guard") -> DataFrame:
    """Hits of each check over guarded texts, by the names that checks emit: check_name, hits, share of all texts, level."""
    total = guarded.agg(F.count("*").alias("total"))
    hits = guarded.select(F.explode_outer(f"{guard}.blocked_by").alias("check_name")).where("check_name is not null").groupBy("check_name").agg(F.count("*").alias("hits"))
    share = F.col("hits") / F.col("total")
    level = F.when(share < 0.3, "compliant").when(share < 0.5, "medium").otherwise("high")
    return hits.join(F.broadcast(total), F.lit(True)).select("check_name", "hits", rounded(share, 3).alias("share"), level.alias("level"))


def live_rollup(guarded: DataFrame, guard: str = "guard") -> DataFrame:
    """Shares of blocked texts by OWASP category and EU article: framework, key, score, compliant, level.

    OWASP scores are risks (compliant under .3), EU scores their complement (compliant from .7 on). Blocks are counted
    by the names that checks emit.
    """
    spark = guarded.sparkSession
    blocked = guarded.select(F.explode_outer(f"{guard}.blocked_by").alias("check_name")).where("check_name is not null").groupBy("check_name").agg(F.count("*").alias("hits"))
    keys = spark.createDataFrame([("owasp", i) for i, _, _ in OWASP] + [("eu", a) for a, *_ in LIVE_EU], "framework string, key string")
    pairs = spark.createDataFrame([("owasp", k, c) for c, k in LIVE_OWASP] + [("eu", a, c) for a, checks in LIVE_EU for c in checks], "framework string, key string, check_name string")
    hits = pairs.join(blocked, "check_name").groupBy("framework", "key").agg(F.sum("hits").alias("hits"))
    rows = keys.join(hits, ["framework", "key"], "left").join(F.broadcast(guarded.agg(F.count("*").alias("total"))), F.lit(True))
    share = F.least(F.lit(1.0), F.coalesce("hits", F.lit(0)) / F.greatest("total", F.lit(1)))
    score = F.when(F.col("framework") == "owasp", rounded(share, 3)).otherwise(rounded(F.lit(1.0) - share, 3))
    made = rows.select("framework", "key", score.alias("score"))
    good = F.when(F.col("framework") == "owasp", F.col("score") < 0.3).otherwise(F.col("score") >= 0.7)
    return made.withColumn("compliant", good).withColumn("level", F.when(F.col("framework") == "eu", F.when(F.col("score") < 0.5, "high").when(F.col("score") < 0.8, "medium").otherwise("low")))


def live_posture(rollup: DataFrame) -> DataFrame:
    """Share of compliant keys of each framework, with the live roll-up's own grades."""
    pct = rounded(F.count_if("compliant") * 100 / F.count("*"), 1)
    a = rollup.groupBy("framework").agg(pct.alias("score"))
    return a.withColumn("grade", F.when(F.col("score") >= 90, "A").when(F.col("score") >= 80, "B").when(F.col("score") >= 70, "C").when(F.col("score") >= 60, "D").otherwise("F"))
