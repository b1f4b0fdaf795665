"""Documents to tables on Spark: text cleaning, chunking, table assembly and metrics."""
