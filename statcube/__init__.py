"""statcube: crosstabs over pre-aggregated statistical cubes on Spark.

Every public function takes and returns lazy DataFrames; the work runs on the
cluster when the caller acts on the result.
"""

__version__ = "0.1.0"
