"""Spark jobs for the data work behind large-scale source-code security review."""
