"""A step over kept blocks is that over the rows, and needs neither a plan nor a shuffle."""

import numpy as np

from plumbline.functions import storage
from plumbline.operators import perceptron


def test_blocks(spark):
    rows = spark.range(500).selectExpr("array(cast(id % 7 as double), cast(id % 3 as double)) as x", "cast(id % 2 as double) as y", "1D + id % 4 as w", "cast(id % 4 as int) - 1 as part")
    data = storage.kept(rows, by=("part",))
    layers = perceptron.initial([2, 5, 1], "relu", 1)
    blocks = perceptron.Blocks(data, [-1, 0, 1, 2])
    for b, with_held in ((0, True), (1, False), (2, True)):
        want, got = perceptron.step_sums(data, layers, "relu", b, with_held), blocks.sums(layers, "relu", b, with_held)
        assert np.allclose(want[0], got[0], rtol=0, atol=1e-12) and want[1] == got[1]
        assert (want[2] is None and got[2] is None) or abs(want[2] - got[2]) < 1e-12
    blocks.let_go()
    storage.let_go(data)
