"""Training-data operators: ten stand-alone Spark jobs and the corpus pipeline built from them."""
