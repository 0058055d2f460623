"""Analyses kept in versions: a later version replaces an earlier one report by report, and nothing is rewritten in place."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake.lexicon import DEFAULT, Lexicon
from hazardlake.operators.analysis import analyze


@dataclass(frozen=True)
class AnalysisStore:
    """A folder of three tables, partitioned by ``version``: ``analyses``, ``dropped`` (ids of reviews that a version made
    void) and ``commits`` (one row for each finished version).

    A version counts from the moment its row stands in ``commits``, which is written last: whatever a broken run left
    behind is invisible, and the next run of that version writes over it.  A committed version is never written again, so
    repeating a run changes nothing, also when reviews have come in since.  One writer at a time and version is assumed;
    a second one that commits the same number fails.
    """

    spark: SparkSession
    folder: str
    key: str = "report_id"
    review_key: str = "id"

    def committed(self) -> list[int]:
        """Finished versions, rising; a handful of numbers."""
        try:
            rows = self.spark.read.parquet(f"{self.folder}/commits").select("version").collect()
        except AnalysisException:  # no version yet
            return []
        return sorted(r["version"] for r in rows)

    def commit(self, version: int, analyses: DataFrame, dropped: DataFrame | None = None) -> bool:
        """Write a version; False (and no work) if it is there already.

        ``analyses`` holds each key once.  ``dropped`` are the reviews (with ``review_key``) of superseded analyses.
        """
        if version in self.committed():
            return False
        place = f"version={version}"
        analyses.drop("version").write.mode("overwrite").parquet(f"{self.folder}/analyses/{place}")
        if dropped is not None:
            dropped.select(self.review_key).distinct().write.mode("overwrite").parquet(f"{self.folder}/dropped/{place}")
        stamp = self.spark.range(1).select(F.current_timestamp().alias("committed_at"), F.lit(dropped is not None).alias("drops_reviews"))
        stamp.coalesce(1).write.mode("errorifexists").parquet(f"{self.folder}/commits/{place}")
        return True

    def history(self) -> DataFrame:
        """Every analysis of every committed version, with its ``version``; other versions' folders aren't read."""
        versions = self.committed()
        if not versions:
            raise ValueError(f"no version is committed in {self.folder}")
        rows = self.spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/analyses")
        return rows.filter(F.col("version").isin(versions))

    def current(self) -> DataFrame:
        """The newest analysis of each key.

        Only the keys of the later versions are gathered, not their analyses: the first version, which is the large one,
        is read once, and passes by a join with the keys that were replaced.  Rows without a key can't be replaced.
        """
        rows, versions = self.history(), self.committed()
        if len(versions) == 1:
            return rows
        newest = rows.filter(F.col("version") > versions[0]).groupBy(self.key).agg(F.max("version").alias("_newest"))
        joined = rows.join(newest, self.key, "left")
        return joined.filter(F.col(self.key).isNull() | (F.col("version") == F.coalesce("_newest", F.lit(versions[0])))).drop("_newest")

    def reviews(self, reviews: DataFrame) -> DataFrame:
        """Reviews that still speak of the analysis that is shown: all but those a version dropped."""
        versions = self.committed()
        kept = self.spark.read.parquet(f"{self.folder}/commits").filter("drops_reviews").limit(1).count() if versions else 0
        if not kept:
            return reviews
        gone = self.spark.read.parquet(f"{self.folder}/dropped").filter(F.col("version").isin(versions)).select(self.review_key).distinct()
        return reviews.join(gone, self.review_key, "left_anti")

    def states(self, reviews: DataFrame, report_col: str = "report_id") -> DataFrame:
        """Current analyses with ``n_reviews`` that are left and ``review_state``: a replaced analysis is pending again."""
        left = self.reviews(reviews).groupBy(F.col(report_col).alias(self.key)).agg(F.count(F.lit(1)).alias("n_reviews"))
        return (self.current().join(left, self.key, "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))
                .withColumn("review_state", F.when(F.col("n_reviews") > 0, "reviewed").otherwise("pending")))

    def compacted(self, folder: str) -> AnalysisStore:
        """A new store whose first version is what this one shows; the numbers of dropped reviews go with it."""
        made = AnalysisStore(self.spark, folder, self.key, self.review_key)
        versions = self.committed()
        try:
            gone = self.spark.read.parquet(f"{self.folder}/dropped").filter(F.col("version").isin(versions)).drop("version")
        except AnalysisException:  # no version dropped any
            gone = None
        made.commit(versions[-1], self.current(), gone)
        return made


def reanalyse(store: AnalysisStore, version: int, reports: DataFrame, wanted: DataFrame, reviews: DataFrame | None = None, lexicon: Lexicon = DEFAULT,
              text_col: str = "report_text", report_col: str = "report_id", columns: Sequence[str] | None = None) -> bool:
    """Analyse the reports named in ``wanted`` anew, replace their analyses by a new version and drop their reviews.

    ``reports`` hold the store's key and the text; keys of ``wanted`` without a report are ignored.  ``reviews`` name
    their report in ``report_col``; those of the replaced reports spoke of the old result and count no longer, later ones
    do.  Only the wanted reports' texts are analysed, and nothing else of the store is read or written.
    """
    if version in store.committed():
        return False
    keys = wanted.select(store.key).distinct()
    todo = reports.join(keys, store.key, "left_semi")
    done = analyze(todo, text_col, lexicon).drop(text_col)
    replaced = todo.select(F.col(store.key).alias(report_col))
    dropped = None if reviews is None else reviews.join(replaced, report_col, "left_semi")
    return store.commit(version, done.select(*columns) if columns else done, dropped)
