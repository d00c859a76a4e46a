"""Building and maintaining image-annotation datasets on Spark."""
