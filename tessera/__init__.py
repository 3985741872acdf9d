"""Image-container analytics on Spark: bytes, chunks, pixels, tokens and histograms as DataFrames."""
