"""Landed model answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsetrail.functions.text import strip

VERDICT = ("STRUCT<i: STRING, relevant: BOOLEAN, title: STRING, impact: STRING, description: STRING, "
           "date: STRING, scope: ARRAY<STRING>, divisions: ARRAY<STRING>, kpi: ARRAY<STRING>, "
           "category: STRING, impact_direction: STRING, impact_horizon: STRING, impact_strength: INT, "
           "confidence: STRING, metric: STRING, axis: STRING>")


def parse_verdict_batches(answers: DataFrame) -> DataFrame:
    """(batch_id, provider, pos, echoed, verdict) from answer text.

    ``answers``: batch_id, provider, expected, payload.  Code fences are cut
    off.  The answer is an array, or an object with exactly one array value;
    anything else, or a wrong number of verdicts, rejects the batch.
    """
    bare = strip(F.regexp_replace("payload", "```json|```", ""))
    rows = answers.withColumn("_t", bare)
    array = F.from_json(F.when(F.startswith(F.col("_t"), F.lit("[")), F.col("_t")), f"ARRAY<{VERDICT}>")
    # object form: every value as text, then those that are arrays
    values = F.map_values(F.from_json(F.when(F.startswith(F.col("_t"), F.lit("{")), F.col("_t")),
                                      "MAP<STRING, STRING>"))
    arrays = F.filter(values, lambda x: F.startswith(strip(x), F.lit("[")))
    inner = F.from_json(F.when(F.size("_arrays") == 1, F.element_at("_arrays", 1)), f"ARRAY<{VERDICT}>")
    parsed = (rows.withColumn("_a", array).withColumn("_arrays", arrays).withColumn("_b", inner)
              .withColumn("_v", F.coalesce("_a", "_b")))
    return (parsed.filter(F.size("_v") == F.col("expected"))
            .select("batch_id", "provider", F.posexplode("_v").alias("pos", "verdict"))
            .select("batch_id", "provider", (F.col("pos") + 1).alias("pos"),
                    F.col("verdict.i").alias("echoed"), "verdict"))
