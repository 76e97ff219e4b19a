"""gleaner: indicator extraction, lookup and audit as plain Spark DataFrame jobs."""
