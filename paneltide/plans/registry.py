"""Frozen runs: write once, look up, grade when the outcome period has closed.

The scores of all runs frozen together, and the panel they came from, are written under one attempt id; a manifest a run commits it
(`sources.commits`). Readers see committed runs only. A run that is frozen again with the same stamp from the same content (a retry)
is left as it is; any other second freeze is refused.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paneltide.functions.scalar import ratio
from paneltide.operators.order import top_k_overlap, winsorise
from paneltide.plans.walkforward import enough_rows, realised, window_metrics
from paneltide.scale import staged
from paneltide.sources import commits


class PublicationBlocked(RuntimeError):
    """A run may not be frozen while a blocking flag is open."""


class RunExists(RuntimeError):
    """A run of that name was frozen from other content."""


MANIFEST = ("run_id string, stamp string, score_period int, attempt string, digest string, n_rows long, edition_digest string, edition_rows long, "
            "weights map<string,double>")


def _row_part(df: DataFrame, names: Sequence[str]):
    cells = [F.concat(F.lit(f"{c}"), F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")), F.lit(";")) for c in sorted(names)]
    return F.conv(F.substring(F.md5(F.concat(*cells)), 1, 15), 16, 10).cast("decimal(38,0)")


def digest(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Order-insensitive content digest: exact sum of 60-bit MD5 parts of the rows, and the row count.

    A row's text names every column and marks NULL apart from any value, so a value that moves to another
    column, or vanishes, changes the digest. Other engines can recompute it.
    """
    return df.select(*by, _row_part(df, df.columns).alias("h")).groupBy(*by).agg(
        F.sum("h").cast("string").alias("digest"), F.count(F.lit(1)).alias("n_rows"))


def freeze_runs(scores: DataFrame, panel: DataFrame, root: str, runs: Mapping[str, tuple[int, str]], weights: Mapping[str, float],
                gate: DataFrame) -> list[str]:
    """Freeze several editions at once: run_id -> (score period, stamp). Returns the runs that this call committed.

    Scores (one write for all runs) and the panel are written first, then a manifest a run. Fails without trace when the gate is closed,
    a run exists with other content, or a write fails; a retry after a failure, or after success, is safe.
    """
    if not gate.first()["clear"]:  # one row by construction
        raise PublicationBlocked(", ".join(runs))
    spark = scores.sparkSession
    known = spark.createDataFrame([(r, p) for r, (p, _) in runs.items()], "run_id string, period int")
    editions = scores.join(F.broadcast(known), "period")  # one row a run
    own = {r["run_id"]: r for r in digest(editions, ["run_id"]).collect()}
    whole = digest(panel).first()
    before = {r["run_id"]: r for r in committed_runs(spark, root).filter(F.col("run_id").isin(list(runs))).collect()}

    def same(run: str) -> bool:
        held, now = before[run], own.get(run)
        return (held["score_period"], held["stamp"], held["digest"], held["n_rows"], held["edition_digest"], held["edition_rows"]) == (
            *runs[run], whole["digest"], whole["n_rows"], now and now["digest"], now["n_rows"] if now else 0)

    if changed := [r for r in before if not same(r)]:
        raise RunExists(f"already exists: {', '.join(sorted(changed))}")
    if not (new := [r for r in runs if r not in before]):
        return []
    attempt = commits.new_attempt()
    commits.write_part(editions.filter(F.col("run_id").isin(new)), root, "scores", attempt)
    commits.write_part(panel, root, "panel", attempt)
    done = []
    for run in new:  # a small file each
        period, stamp = runs[run]
        try:
            commits.publish(spark, root, run, {
                "run_id": run, "stamp": stamp, "score_period": period, "attempt": attempt, "digest": whole["digest"], "n_rows": whole["n_rows"],
                "edition_digest": own[run]["digest"] if run in own else None, "edition_rows": own[run]["n_rows"] if run in own else 0, "weights": dict(weights)})
        except commits.AlreadyCommitted:
            raise RunExists(f"already exists: {run}") from None
        done.append(run)
    return done


def freeze_run(scores: DataFrame, panel: DataFrame, root: str, run_id: str, score_period: int,
               weights: Mapping[str, float], gate: DataFrame, stamp: str) -> list[str]:
    """One run: scores, panel snapshot and manifest."""
    return freeze_runs(scores, panel, root, {run_id: (score_period, stamp)}, weights, gate)


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """The index: one row a committed run."""
    return commits.manifests(spark, root, MANIFEST)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """Scores of committed runs."""
    return commits.read_part(spark, root, "scores", committed_runs(spark, root), ["run_id"])


def read_panels(spark: SparkSession, root: str) -> DataFrame:
    """Panel snapshots by attempt."""
    return commits.read_part(spark, root, "panel", committed_runs(spark, root), [])


def operative_runs(index: DataFrame, periods: DataFrame) -> DataFrame:
    """Latest run per asked period, else the latest run overall."""
    held = periods.select("score_period").distinct()
    own = index.groupBy("score_period").agg(F.max_by("run_id", "stamp").alias("_own"))
    newest = index.agg(F.max_by("run_id", "stamp")).scalar()
    return held.join(own, "score_period", "left").select(
        "score_period", F.coalesce(F.col("_own"), newest).alias("run_id"), F.col("_own").isNotNull().alias("exact"))


def grade_runs(runs: DataFrame, target: DataFrame, value: str, horizon: int, current: DataFrame, k: int = 10,
               bound: int | None = None) -> DataFrame:
    """Grade every closed run; open runs report the period they wait for.

    ``runs`` has (run_id, entity, period, score); ``current`` the scores of the present model. The outcome is clipped once,
    over the entities of the run, and both models meet that outcome; they are compared where at least k entities have both scores.
    """
    outcome = realised(target, value, [horizon])
    window = ["run_id", "period"]
    rows = staged(winsorise(runs.filter(F.col("score").isNotNull()).join(outcome, ["entity", "period"]), window, "realized", bound=bound), "graded")
    mine = window_metrics(rows, window, k=k, clip=False, bound=bound)
    held = current.filter(F.col("score").isNotNull()).select("entity", "period", F.col("score").alias("_now"))
    paired = staged(enough_rows(rows.join(held, ["entity", "period"]), window, k, bound), "paired")
    now = paired.drop("score").withColumnRenamed("_now", "score")
    theirs = window_metrics(now, window, k=k, clip=False, at_least=k, bound=bound).select(
        "run_id", F.col("weighted_tau").alias("current_tau"))
    shared = top_k_overlap(paired, now, ["run_id"], "entity", "score", k)
    newest = target.filter(F.col(value).isNotNull()).agg(F.max("period")).scalar()
    listed = runs.groupBy("run_id").agg(F.max("period").alias("score_period")).withColumn("_latest", newest)
    return (listed.join(mine.drop("period"), "run_id", "left").join(theirs, "run_id", "left").join(shared, "run_id", "left")
            .select("run_id", "score_period", (F.col("score_period") + horizon <= F.col("_latest")).alias("closed"),
                    F.when(F.col("score_period") + horizon > F.col("_latest"), F.col("score_period") + horizon).alias("waits_for"),
                    "n_entities", "weighted_tau", "precision_at_k", "edge_pp", "current_tau",
                    ratio("weighted_tau", "current_tau").alias("retention"), "overlap"))


def grade_interim(runs: DataFrame, outcomes: Sequence[DataFrame], k: int = 10, bound: int | None = None) -> DataFrame:
    """Early reads: the same metrics against shorter or part-period outcomes (read, entity, period, realized).

    Each outcome is clipped over all its entities, before it meets the entities of a run.
    """
    stacked = outcomes[0]
    for more in outcomes[1:]:
        stacked = stacked.unionByName(more)
    clipped = winsorise(stacked.filter(F.col("realized").isNotNull()), ["read", "period"], "realized", bound=bound)
    rows = runs.filter(F.col("score").isNotNull()).join(clipped, ["entity", "period"])
    return window_metrics(rows, ["run_id", "read", "period"], k=k, clip=False, bound=bound)
