"""Dashboard aggregates, trends, rankings and recurring patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    return F.when(whole > 0, F.round(F.lit(100.0) * part / whole, digits)).otherwise(F.lit(0.0))


def overview(reports: DataFrame, findings: DataFrame) -> DataFrame:
    """Key figures in one aggregate over the outer join."""
    joined = reports.select("id", "is_demo", "created_at").join(
        findings.select("report_pk", "sif_potential", "priority"), F.col("id") == F.col("report_pk"), "left")
    return (joined.agg(
        F.count(F.lit(1)).alias("total_reports"), F.count_if(F.col("sif_potential")).alias("sif_reports"),
        F.count_if(F.col("priority") == "HIGH").alias("high_reports"), F.count_if(F.col("is_demo")).alias("demo_reports"),
        F.max("created_at").alias("latest_created"))
        .withColumn("sif_density", percent(F.col("sif_reports"), F.col("total_reports"))))


def data_note(total: Column, demo: Column) -> Column:
    return (F.when(total == 0, F.lit("Nothing imported yet."))
            .when(demo == total, F.lit("Demo reports only."))
            .when(demo > 0, F.concat(demo.cast("string"), F.lit(" demo reports among "), total.cast("string"), F.lit(".")))
            .otherwise(F.lit("Imported reports only.")))


def mode(df: DataFrame, column: str) -> DataFrame:
    """Most frequent value with its count; ties go to the smaller value."""
    return (df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), column).limit(1))


def rule_distribution(findings: DataFrame, rules: list[str]) -> DataFrame:
    """All rules in fixed order: count over every analysis, percentage over SIF reports only."""
    spark = findings.sparkSession
    spine = spark.createDataFrame([(n, r) for n, r in enumerate(rules)], "rule_order int, rule string")
    counts = findings.groupBy(F.col("life_saving_rule").alias("rule")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sif_potential")).alias("sif"))
    # The spine has one row per configured rule, so the window below sees that many rows only.
    filled = F.broadcast(spine).join(counts, "rule", "left").select(
        "rule_order", "rule", F.coalesce("n", F.lit(0)).alias("report_count"), F.coalesce("sif", F.lit(0)).alias("sif_count"))
    return filled.withColumn("percentage", percent(F.col("sif_count"), F.sum("sif_count").over(Window.partitionBy())))


def value_pairs(rows: DataFrame, group: str, values: dict[str, str], *keep: str) -> DataFrame:
    """A row for each named value of a row, and one without a name for the row itself; ``keep`` columns stay with that one."""
    kept = lambda on: [F.col(c).alias(c) if on else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in keep]
    parts = [F.struct(F.lit("").alias("name"), F.lit(None).cast("string").alias("value"), *kept(True))]
    parts += [F.struct(F.lit(n).alias("name"), F.col(c).alias("value"), *kept(False)) for n, c in values.items()]
    return rows.select(group, F.explode(F.array(*parts)).alias("p")).select(group, "p.*").filter("name = '' OR value IS NOT NULL")


def ranked_lists(pairs: DataFrame, group: str, names: list[str], counts: dict[str, Column], k: int = 3) -> DataFrame:
    """Per group its counts and, for each name, its k most frequent values; ties go to the smaller value.

    One pass over ``pairs``: one aggregate per (group, name, value), a rank among the distinct values whose limit also
    runs before its shuffle, and one row per group.
    """
    per = pairs.groupBy(group, "name", "value").agg(F.count(F.lit(1)).alias("_n"), *[c.alias(f"_c_{n}") for n, c in counts.items()])
    order = Window.partitionBy(group, "name").orderBy(F.desc("_n"), "value")
    top = per.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    itself = F.col("name") == ""
    listed = lambda n: F.transform(F.array_sort(F.collect_list(F.when(F.col("name") == n, F.struct("_rank", "value")))), lambda s: s["value"])
    return top.groupBy(group).agg(F.max(F.when(itself, F.col("_n"))).alias("n"), *[F.max(F.when(itself, F.col(f"_c_{n}"))).alias(n) for n in counts],
                                  *[listed(n).alias(n) for n in names])


def top_values(df: DataFrame, group: str, value: str, k: int = 3) -> DataFrame:
    """The k most frequent values per group as one ordered list; groups without a value are left out."""
    return ranked_lists(value_pairs(df, group, {"values": value}), group, ["values"], {}, k).select(group, "values").filter(F.size("values") > 0)


def first_ids(df: DataFrame, group: list[str], id_col: str = "id", k: int = 3) -> DataFrame:
    """The k smallest ids per group; the rank limit runs before the shuffle too."""
    order = Window.partitionBy(*group).orderBy(id_col)
    top = df.select(*group, id_col).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    return top.groupBy(*group).agg(F.array_sort(F.collect_list(id_col)).alias("examples"))


def site_risk(reports: DataFrame, findings: DataFrame) -> DataFrame:
    rows = reports.filter(F.col("site").isNotNull()).select("id", "site").join(
        findings.filter("sif_potential"), F.col("id") == F.col("report_pk")).select("site", "hazard", "life_saving_rule", "priority")
    lists = {"main_hazards": "hazard", "main_rules": "life_saving_rule"}
    return ranked_lists(value_pairs(rows, "site", lists, "priority"), "site", list(lists), {"high": F.count_if(F.col("priority") == "HIGH")})


def activity_risk(findings: DataFrame, barrier_rows: DataFrame) -> DataFrame:
    rows = findings.filter("sif_potential").select(
        "report_pk", F.coalesce(F.nullif("analysis_activity", F.lit("")), F.lit("Not specified")).alias("activity"), "hazard", "life_saving_rule",
        F.coalesce("priority", F.lit("LOW")).alias("level"))
    pairs = value_pairs(rows, "activity", {"main_hazards": "hazard", "main_rules": "life_saving_rule"}, "level")
    barriers = rows.select("report_pk", "activity").join(barrier_rows, "report_pk").select(
        "activity", F.lit("main_barriers").alias("name"), F.col("barrier").alias("value"), F.lit(None).cast("string").alias("level"))
    counts = {f"n_{p.lower()}": F.count_if(F.col("level") == p) for p in ("HIGH", "MEDIUM", "LOW")}
    return ranked_lists(pairs.unionByName(barriers), "activity", ["main_hazards", "main_barriers", "main_rules"], counts)


def priority_map(findings: DataFrame) -> DataFrame:
    """Counts per activity and priority as a map holding only the priorities that occur."""
    counts = (findings.filter("sif_potential")
              .groupBy(F.coalesce(F.nullif("analysis_activity", F.lit("")), F.lit("Not specified")).alias("activity"),
                       F.coalesce("priority", F.lit("LOW")).alias("level")).agg(F.count(F.lit(1)).alias("n")))
    return counts.groupBy("activity").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("level", "n")))).alias("priority_distribution"))


def barrier_analysis(reports: DataFrame, findings: DataFrame, barrier_rows: DataFrame) -> DataFrame:
    """Every analysis counts here, SIF or not."""
    rows = (barrier_rows.join(findings.select("report_pk", "analysis_activity", "life_saving_rule"), "report_pk")
            .join(reports.select(F.col("id").alias("report_pk"), "site"), "report_pk"))
    lists = {"sites": "site", "activities": "analysis_activity", "rules": "life_saving_rule"}
    out = ranked_lists(value_pairs(rows, "barrier", lists), "barrier", list(lists), {})
    return out.join(first_ids(rows, ["barrier"], "report_pk"), "barrier", "left")


def pattern_keys(findings: DataFrame, barrier_rows: DataFrame) -> DataFrame:
    """(kind, a, b, report_pk) of every recurring-pattern key of a SIF report."""
    sif = findings.filter("sif_potential")
    both = sif.filter("life_saving_rule IS NOT NULL AND analysis_activity IS NOT NULL").select(
        F.lit("rule + activity").alias("kind"), F.col("life_saving_rule").alias("a"),
        F.col("analysis_activity").alias("b"), "report_pk")
    barrier = sif.filter("life_saving_rule IS NOT NULL").join(barrier_rows, "report_pk").select(
        F.lit("rule + barrier").alias("kind"), F.col("life_saving_rule").alias("a"), F.col("barrier").alias("b"), "report_pk")
    hazard = sif.filter("hazard IS NOT NULL AND analysis_activity IS NOT NULL").select(
        F.lit("hazard + activity").alias("kind"), F.col("hazard").alias("a"), F.col("analysis_activity").alias("b"),
        "report_pk")
    return both.unionByName(barrier).unionByName(hazard)


def patterns(findings: DataFrame, barrier_rows: DataFrame, limit: int = 20) -> DataFrame:
    """Keys on two or more SIF reports, most frequent first, with titles and up to three example reports.

    Counting and the three smallest ids share one shuffle-light aggregate; the example list is
    joined only to the ``limit`` rows that are kept.
    """
    keys = pattern_keys(findings, barrier_rows)
    top = (keys.groupBy("kind", "a", "b").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= 2)
           .orderBy(F.desc("n"), "kind", "a", "b").limit(limit))
    # ``top`` holds at most ``limit`` rows, so broadcasting it is bounded.
    kept = keys.join(F.broadcast(top.select("kind", "a", "b")), ["kind", "a", "b"], "left_semi")
    examples = first_ids(kept, ["kind", "a", "b"], "report_pk")
    during = F.concat("a", F.lit(" during "), F.lower("b"))
    title = F.when(F.col("kind") == "rule + barrier", F.concat("a", F.lit(" with "), F.lower("b"), F.lit(" failures"))
                   ).otherwise(during)
    detail = F.when(F.col("kind") == "rule + barrier", F.concat(
        "a", F.lit(" precursors repeatedly involve failed "), F.lower("b"), F.lit(" controls."))
    ).otherwise(F.concat("a", F.lit(" precursors recur during "), F.lower("b"), F.lit(" activities.")))
    return (top.join(examples, ["kind", "a", "b"], "left").withColumns({"title": title, "detail": detail}))


# ---- weekly trend ----------------------------------------------------------

def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def weekly_counts(reports: DataFrame, findings: DataFrame) -> DataFrame:
    day = F.coalesce(F.col("date"), F.col("created_at").cast("date"))
    rows = reports.select("id", day.alias("day")).join(
        findings.select("report_pk", "sif_potential"), F.col("id") == F.col("report_pk"), "left")
    return rows.filter(F.col("day").isNotNull()).groupBy(week_start(F.col("day")).alias("week")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("sif_potential")).alias("sif_count"), F.max("day").alias("last_day"))


def weekly_trend(reports: DataFrame, findings: DataFrame, weeks: int = 8) -> DataFrame:
    """The last weeks up to the newest report, zero-filled; labels step back from that day by sevens."""
    counts = weekly_counts(reports, findings)
    anchor = counts.agg(F.max("last_day").alias("anchor"))
    spine = anchor.select(F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))).alias("back"), "anchor").select(
        (F.lit(weeks - 1) - F.col("back")).alias("week_index"), F.date_sub("anchor", F.col("back") * 7).alias("label_day"))
    spine = spine.withColumn("week", week_start(F.col("label_day")))
    # ``spine`` has ``weeks`` rows.
    return F.broadcast(spine).join(counts, "week", "left").select(
        "week_index", "week", F.date_format("label_day", "dd MMM").alias("period"),
        F.coalesce("n", F.lit(0)).alias("report_count"), F.coalesce("sif_count", F.lit(0)).alias("sif_count"))


def density_trend(trend: DataFrame, last: int = 4) -> DataFrame:
    density = F.when(F.col("report_count") > 0, F.round(F.lit(1000.0) * F.col("sif_count") / F.col("report_count")) / 10)
    top = F.max("week_index").over(Window.partitionBy())  # eight rows
    return (trend.withColumn("_top", top).filter(F.col("week_index") > F.col("_top") - last)
            .select("week_index", "week", F.coalesce(density, F.lit(0.0)).alias("density")))


def week_delta(trend: DataFrame) -> DataFrame:
    """Change of the last week against the one before; null without a base."""
    order = Window.orderBy("week_index")  # eight rows
    lagged = trend.withColumns({"prev_count": F.lag("report_count").over(order), "prev_sif": F.lag("sif_count").over(order)})
    change = lambda now, before: F.when(F.col(before) > 0, F.round(
        F.lit(100.0) * (F.col(now) - F.col(before)) / F.col(before), 0))
    return lagged.select("week_index", change("report_count", "prev_count").alias("count_delta"),
                         change("sif_count", "prev_sif").alias("sif_delta"))
