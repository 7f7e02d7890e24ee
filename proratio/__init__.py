"""proratio: price allocation and pricing governance as Spark DataFrame jobs."""
