"""Text analytics on Spark: cleaning, grading, segmenting, topics, codebooks and exports of short free-text records."""
