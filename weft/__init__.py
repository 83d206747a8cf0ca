"""weft: a Spark-native engine for multimodal training-data preparation and scoring.

Every public function takes and returns DataFrames. Random choices come from a keyed
hash (see :mod:`weft.ids`) so results do not depend on partitioning or task retries.
"""

__version__ = "0.1.0"
