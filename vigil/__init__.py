"""vigil: Spark-native daily-series early-warning analytics.

Every public function takes and returns Spark DataFrames (or Column
expressions); work is partitioned by series keys so that it scales with the
number of series and days, not with one machine.
"""

__version__ = "0.1.0"
