"""Taking votes in and showing them: what is rejected and why, and the board of both kinds of votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import feedback


def submitted(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw votes as normalised events that may be logged, and the others with a ``status`` of 400 and an ``error``.

    A missing kind is a citation vote; a thumb must be one of those known.
    """
    text = lambda c, default: F.lower(F.trim(F.coalesce(F.col(c), F.lit(default))))
    bad = F.when(~text("thumb", "").isin(*feedback.THUMBS), f"thumb is none of {', '.join(feedback.THUMBS)}").when(~text("feedback_type", "citation").isin(*feedback.KINDS, ""), f"feedback_type is none of {', '.join(feedback.KINDS)}")
    rows = raw.withColumn("error", bad)
    return feedback.normalised(rows.where("error is null").drop("error")), rows.where("error is not null").withColumn("status", F.lit(400))


def board(events: DataFrame, chunks: DataFrame, now: Column, *, most: int = 50) -> tuple[DataFrame, DataFrame]:
    """The summary of both kinds over each target's last vote, and the newest votes against, with their chunks' titles and previews."""
    keys = "feedback_type", "conversation_id", "turn_id", "target_chunk_id"
    current = feedback.latest(feedback.with_first_line(events, *keys), *keys)
    return feedback.summary(current, now), feedback.enriched(feedback.negatives(current, most=most), chunks)
