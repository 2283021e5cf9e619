"""kiln — tabular analytics and statistical process control on Spark DataFrames.

Every operator takes and returns Spark DataFrames; all heavy work is expressed
with DataFrame expressions, aggregations, windows and ``pyspark.ml`` so that
Catalyst plans it and the cluster executes it.
"""

from kiln.core import get_session

__all__ = ["get_session"]
