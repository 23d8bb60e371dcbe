"""Column functions: row-wise, JVM-side, usable on batch and streaming frames."""
