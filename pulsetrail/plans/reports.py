"""End-to-end reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsetrail.operators import attribution as A, periods as P, scoring as S


def movement_explained(ledger: DataFrame, series: DataFrame, periods: DataFrame) -> DataFrame:
    """How far each series moved and which groups of events explain it."""
    verdicts = P.period_verdict(series, periods)
    groups = A.category_attribution(A.with_move(ledger, verdicts))
    return (verdicts.select("series_id", "pct", "direction")
            .join(groups, "series_id", "left"))


def credibility(ledger: DataFrame, series: DataFrame, rivals: DataFrame,
                month_minimum: int = 20, permutations: int = 1000) -> dict[str, DataFrame]:
    """Hit rates, pressure correlation and the permutation test as frames."""
    own = series.join(rivals.select(F.col("subject_id").alias("series_id")).distinct(),
                      "series_id", "left_semi")
    spans = S.overlap_span(ledger, own)
    dense = S.dense_window(ledger, spans, month_minimum)
    dense = (dense.join(spans.select("series_id", "start"), "series_id")
             .select("series_id", F.coalesce("dense_start", "start").alias("dense_start"), "end"))
    pressure = S.pressure_index(ledger, spans)
    targets = S.axis_targets(series, rivals, spans)
    corr = S.pressure_correlation(pressure, targets, dense)
    scores = S.hit_scores(ledger, own)
    return {"pressure": pressure, "correlation": corr, "scores": scores,
            "summary": S.hit_summary(scores),
            "permutation": S.permutation_test(ledger, dense, targets,
                                              corr.filter(F.col("stretch") == "dense"), permutations)}
