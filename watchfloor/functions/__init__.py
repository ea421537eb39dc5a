"""Column-to-Column building blocks; everything here stays inside generated JVM code."""
