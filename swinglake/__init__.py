"""Shot analytics on Spark: session logs, radar captures, pairing, accuracy and streaming statistics."""
