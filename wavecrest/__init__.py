"""Time-series feature analytics expressed as Spark plans."""
