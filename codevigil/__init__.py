"""Code-health analytics over corpora of files, symbols, findings and review events, on Spark."""
