import pandas as pd

from plumbline.operators import intervals


def test_intervals_read_the_rows_twice(spark):
    """Once for the cells, once for the cuts of the score range; and the bounds are those of the two kinds alone."""
    n = 60
    pdf = pd.DataFrame({"entity": ["x", "r"] * n, "sample_id": range(2 * n), "y_true": [(k // 2 * 7) % 3 % 2 for k in range(2 * n)]})
    pdf["y_prob"] = [None if k % 2 else (k * 37 % 101 + 40 * y) / 150 for k, y in enumerate(pdf.y_true)]
    pdf["y_pred"] = [(k * 13) % 7 % 2 for k in range(2 * n)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(pdf).selectExpr("entity", "sample_id", "y_true", "nullif(y_prob, double('NaN')) AS y_prob", "y_pred").coalesce(1)
    pred = df.mapInArrow(counted, df.schema)
    got = intervals.all_intervals(pred, ["entity"], b=100).toPandas()
    assert read.value <= 2 * len(pdf)
    want = pd.concat([intervals.count_intervals(df, ["entity"], b=100).toPandas(), intervals.score_intervals(df, ["entity"], b=100).toPandas()])
    order = ["entity", "metric"]
    pd.testing.assert_frame_equal(got.sort_values(order, ignore_index=True), want.sort_values(order, ignore_index=True))
    assert len(got) == 9 * 2 + 5
