"""A radius that one-bit balls cannot cover."""

import pytest

from strandspark.llm import simhash


def test_radius_beyond_the_balls_is_refused(spark):
    with pytest.raises(ValueError, match="radius"):
        simhash.classes(spark.createDataFrame([(0,), (7,)], "fp long"), radius=3)
