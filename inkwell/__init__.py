"""Knowledge-corpus jobs on Spark: ingest, chunk, retrieve, evaluate, scan."""
