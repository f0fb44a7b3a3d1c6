import numpy as np
import pytest

from textwarden.llm.vectors import SCHEMA, summed, vector_rows


@pytest.mark.parametrize("size", [1, 4096, 10_001])
def test_sum_of_partial_vectors(spark, size):
    def make(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                x = np.zeros(size)
                x[i % size] = i
                x[-1] += 0.5
                yield vector_rows(x)

    want = np.zeros(size)
    for i in range(50):
        want[i % size] += i
        want[-1] += 0.5
    assert np.allclose(summed(spark.range(50).repartition(7).mapInArrow(make, SCHEMA), size), want)
    assert not summed(spark.range(0).mapInArrow(make, SCHEMA), size).any()
