"""Independent judges: pairs, agreement, priority, alignment, usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsetrail.functions import measures as M


def rater_pairs(verdicts: DataFrame) -> DataFrame:
    """All unordered provider pairs per item (providers per item are few)."""
    a = verdicts.select("item_id", *[F.col(c).alias(f"a_{c}") for c in verdicts.columns if c != "item_id"])
    b = verdicts.select("item_id", *[F.col(c).alias(f"b_{c}") for c in verdicts.columns if c != "item_id"])
    return a.join(b, "item_id").filter(F.col("a_provider") < F.col("b_provider"))


def rater_agreement(verdicts: DataFrame) -> DataFrame:
    """Agreement rates per pair and pooled (pair 'ALL').

    Labels are compared only where both judged the item relevant.
    """
    both = F.col("a_relevant") & F.col("b_relevant")
    rate = lambda test: M.half_up(F.avg(F.when(both, test.cast("int"))), 3)
    gap = F.abs(F.coalesce("a_strength", F.lit(0)) - F.coalesce("b_strength", F.lit(0)))
    pair = F.concat_ws("|", F.col("a_provider").cast("string"), F.col("b_provider").cast("string"))
    out = rater_pairs(verdicts).withColumn("pair", pair).rollup("pair").agg(
        M.half_up(F.avg((F.col("a_relevant") == F.col("b_relevant")).cast("int")), 3).alias("relevant"),
        rate(F.col("a_direction").eqNullSafe(F.col("b_direction"))).alias("direction"),
        rate(M.clean_axis(F.col("a_axis")) == M.clean_axis(F.col("b_axis"))).alias("axis"),
        rate(gap == 0).alias("strength"), rate(gap <= 1).alias("strength_within_1"),
        F.count("*").alias("n"))
    return out.withColumn("pair", F.coalesce("pair", F.lit("ALL")))


def first_accepted(verdicts: DataFrame, accepted: Column, priority: str = "priority") -> DataFrame:
    """Per item, the accepted verdict of the highest-ranked provider."""
    rest = [c for c in verdicts.columns if c != "item_id"]
    return (verdicts.filter(accepted).groupBy("item_id")
            .agg(F.min_by(F.struct(*rest), priority).alias("_v")).select("item_id", "_v.*"))


def align_batches(verdicts: DataFrame) -> DataFrame:
    """Seat each verdict of a batch by its echoed number where that is safe.

    Input: (batch_id, pos 1..n, echoed).  When the echoed numbers of a batch
    are exactly 1..n they give the seat (``reordered`` if they differ from
    the position); otherwise the position stays and the batch is unverified.
    Distinctness is decided by counts, so no batch is collected.
    """
    from pyspark.sql import Window
    k = F.col("echoed").try_cast("int")
    per = verdicts.groupBy("batch_id").agg(
        F.count("*").alias("_n"), F.countDistinct(k).alias("_d"), F.min(k).alias("_lo"),
        F.max(k).alias("_hi"), F.count_if(k != F.col("pos")).alias("_moved"))
    ok = (F.col("_d") == F.col("_n")) & (F.col("_lo") == 1) & (F.col("_hi") == F.col("_n"))
    return (verdicts.join(per, "batch_id")
            .withColumn("verified", F.coalesce(ok, F.lit(False)))
            .withColumn("seat", F.when(F.col("verified"), k).otherwise(F.col("pos")))
            .withColumn("reordered", F.col("verified") & (F.col("_moved") > 0))
            .drop("_n", "_d", "_lo", "_hi", "_moved"))


def provider_usage(calls: DataFrame, counters) -> DataFrame:
    """Per provider one column per counter, plus total attempts.

    An accepted answer in the wrong language (``language_reject``) is moved
    from ``ok`` to the rejects.
    """
    wide = calls.groupBy("provider").pivot("counter", list(counters)).agg(F.sum("n"))
    wide = wide.na.fill(0, list(counters))
    if "ok" in counters and "language_reject" in counters:
        wide = wide.withColumn("ok", F.col("ok") - F.col("language_reject"))
    return wide


def total_attempts(calls: DataFrame) -> DataFrame:
    """HTTP attempts over all providers of each run."""
    return (calls.filter(F.col("counter") == "attempt").groupBy("run_at", "stage")
            .agg(F.sum("n").alias("total_attempts")))
