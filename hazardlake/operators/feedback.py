"""Reviewer feedback: capture, agreement and learned signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions import text as tx
from hazardlake.functions.columns import let, word_list
from hazardlake.operators.metrics import confusion, with_scores
from hazardlake.operators.registry import human_sif

# Filler words that alone make no signal.
SIGNAL_STOP = """the and was were with from that this have had has been not but for are his her she one two reported
report said told while during when then they their there him them who which will would should could also after before
been being into onto than very just about every some any all more most other such only work worker workers site team
job made make done""".split()
MIN_PHRASE = 6


def capture(reviews: DataFrame, findings: DataFrame) -> DataFrame:
    """Review decisions with the analysis at review time; the reviewer's corrected rule and priority, or else its own."""
    joined = reviews.join(findings.select("report_pk", F.col("sif_potential").alias("ai_sif"), F.col("life_saving_rule").alias("ai_rule"),
                                          F.col("priority").alias("ai_priority")), "report_pk", "left")
    return joined.select(
        "id", "report_pk", F.coalesce("decision", F.lit("reviewed")).alias("decision"), "ai_sif", "ai_rule", "ai_priority",
        human_sif(F.coalesce("decision", F.lit("reviewed")), F.col("ai_sif")).alias("human_sif"),
        F.coalesce("corrected_rule", "ai_rule").alias("human_rule"), F.coalesce("corrected_priority", "ai_priority").alias("human_priority"))


def summary(feedback: DataFrame) -> DataFrame:
    """Totals and counts per decision as rows."""
    per = feedback.groupBy(F.coalesce("decision", F.lit("reviewed")).alias("decision")).agg(
        F.count(F.lit(1)).alias("n"), F.count("human_sif").alias("labelled"))
    return per


def agreement(feedback: DataFrame) -> DataFrame:
    """Model against reviewers over decided feedback; unknown predictions count as true negatives."""
    decided = feedback.filter(F.col("human_sif").isNotNull())
    scored = with_scores(confusion(decided, F.col("human_sif"), F.col("ai_sif")))
    return scored.withColumn("agreement", F.round(F.col("accuracy") * 100, 1))


def phrases(text: Column, domain: list[str], sizes: tuple[int, ...] = (2, 3, 4)) -> Column:
    """Distinct contiguous word runs that name something of the domain and are not all filler."""
    marked = F.transform(tx.words(text), lambda w: F.struct(
        w.alias("w"), F.array_contains(word_list(domain), w).alias("d"), F.array_contains(word_list(SIGNAL_STOP), w).alias("s")))

    def runs(ws: Column, n: int) -> Column:
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - (n - 1))).otherwise(F.array().cast("array<int>"))
        grams = F.transform(starts, lambda i: F.slice(ws, i, n))
        useful = F.filter(grams, lambda g: F.exists(g, lambda x: x["d"]) & ~F.forall(g, lambda x: x["s"]))
        return F.transform(useful, lambda g: F.array_join(F.transform(g, lambda x: x["w"]), " "))

    # Plain strings: the distinct is hashed, so long texts stay linear.
    joined = let(marked, lambda ws: F.concat(*[runs(ws, n) for n in sizes]))
    return F.array_distinct(F.filter(joined, lambda p: F.length(p) >= MIN_PHRASE))


def word_count(phrase: Column) -> Column:
    return F.size(F.split(phrase, " "))


def phrase_counts(feedback: DataFrame, domain: list[str], text_col: str = "report_text") -> DataFrame:
    """Per phrase: feedback rows that missed SIF, flagged it wrongly, or agreed.

    One aggregate answers both the counts and the veto by agreeing rows, so there is no anti
    join and frequent phrases are combined before the shuffle.
    """
    missed = F.coalesce(F.col("human_sif") & ~F.col("ai_sif"), F.lit(False))
    wrong = F.coalesce(~F.col("human_sif") & F.col("ai_sif"), F.lit(False))
    side = F.when(missed, "+").when(wrong, "-").otherwise("=")
    rows = feedback.select(side.alias("side"), F.explode_outer(phrases(F.col(text_col), domain)).alias("p")).filter(F.col("p").isNotNull())
    counts = rows.groupBy(F.col("p").alias("phrase")).agg(
        F.count_if(F.col("side") == "+").alias("missed"), F.count_if(F.col("side") == "-").alias("wrong"),
        F.count_if(F.col("side") == "=").alias("agreed"))
    return counts.withColumn("words", word_count(F.col("phrase")))


def mine_signals(feedback: DataFrame, domain: list[str], text_col: str = "report_text", k: int = 8) -> DataFrame:
    """The k most frequent missed-SIF phrases and the k most frequent false-alarm phrases, none seen in agreeing reports."""
    free = phrase_counts(feedback, domain, text_col).filter(F.col("agreed") == 0)
    sides = F.array(F.struct(F.lit("+").alias("direction"), F.col("missed").alias("reports")),
                    F.struct(F.lit("-").alias("direction"), F.col("wrong").alias("reports")))
    rows = free.select("phrase", "words", F.explode(sides).alias("s")).select("phrase", "words", "s.direction", "s.reports").filter(F.col("reports") > 0)
    top = lambda side: rows.filter(F.col("direction") == side).orderBy(F.desc("reports"), "phrase").limit(k)
    return (top("+").unionByName(top("-"))
            .select("phrase", "direction", "reports", (F.col("reports") * F.col("words")).alias("weight")))


def latest_signals(runs: DataFrame) -> DataFrame:
    """Signals of the newest training run."""
    newest = runs.agg(F.max_by("signals", "run_id").alias("signals"))
    return newest.select(F.explode("signals").alias("s")).select("s.*")
