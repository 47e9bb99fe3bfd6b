"""Running confusion counts of a stream of predictions, in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.metrics import count_if


def windowed(pred: DataFrame, ts: str = "ts", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """window start, entity, tp, fp, tn, fn; rows later than `late` are dropped by the watermark."""
    y, p = F.col("y_true"), F.col("y_pred")
    rows = pred.withWatermark(ts, late) if pred.isStreaming else pred
    out = rows.groupBy(F.window(ts, width).alias("w"), "entity").agg(
        count_if((y == 1) & (p == 1)).alias("tp"), count_if((y == 0) & (p == 1)).alias("fp"), count_if((y == 0) & (p == 0)).alias("tn"), count_if((y == 1) & (p == 0)).alias("fn")
    )
    return out.select(F.col("w.start").alias("start"), "entity", "tp", "fp", "tn", "fn")
