"""wardline: Spark-native analytics for sparse, multi-channel per-entity time series.

Every public function takes and returns DataFrames; nothing is collected to the
driver except fitted statistics (a handful of numbers per channel) and
per-partition totals whose count is bounded by the partition count.
"""

__version__ = "0.1.0"
