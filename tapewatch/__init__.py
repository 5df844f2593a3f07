"""Trade-bar anomaly analytics written as Spark jobs."""
