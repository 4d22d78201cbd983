"""Track-observation analytics and dataset governance as Spark jobs."""
