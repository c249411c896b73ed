"""pagelens: page analysis and page similarity as Spark DataFrame jobs."""
