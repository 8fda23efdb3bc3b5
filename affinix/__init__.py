"""affinix: recommendation analytics as Spark DataFrame programs."""
