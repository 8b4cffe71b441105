"""Visual-observation analytics on Spark: frames in, confidence-scored observations out."""
