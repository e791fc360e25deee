"""Column-level functions; everything here stays inside the JVM unless noted."""
