"""Forests are as deep as Spark allows by default."""

import pytest

from kiln.operators import ml


@pytest.mark.parametrize("name, kind", [("Random Forest Regressor", ml.REGRESSION), ("Random Forest Classifier", ml.CLASSIFICATION)])
def test_default_depth(spark, name, kind):
    assert ml.get_estimator(name, kind).getMaxDepth() == 30
