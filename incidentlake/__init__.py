"""Security-incident analytics as PySpark DataFrame, SQL and MLlib jobs."""
