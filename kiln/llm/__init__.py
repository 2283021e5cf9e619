"""Operators of a training-data pipeline over ``documents``, ``pages``, ``labels``.

Nothing else in the library imports this package.  Functions that run inside
Python workers are pickled by value, so workers need no copy of the repository
on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
