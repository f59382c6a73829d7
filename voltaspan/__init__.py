"""Battery time-series analytics and corpus preparation as Spark DataFrame transformations."""
