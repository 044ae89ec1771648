"""Region analytics on images held as Spark tables."""
