"""Flight-risk scoring on pyspark.ml."""
