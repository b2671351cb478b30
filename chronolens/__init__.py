"""chronolens: activity-memory analytics expressed as Spark DataFrames."""
