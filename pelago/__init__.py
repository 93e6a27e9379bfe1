"""pelago: Spark-first feature, quality, evaluation and attribution operators."""
