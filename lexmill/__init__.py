"""Document retrieval, text analytics and evaluation statistics on Spark."""
