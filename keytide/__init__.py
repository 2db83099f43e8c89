"""Skew-aware, order-preserving processing of keyed event streams on Spark.

Every public function takes and returns DataFrames (or Columns) and has its
parameters spelled out; nothing reads global configuration.
"""

__version__ = "0.1.0"
