"""Column functions (JVM-side expressions) and fixed rule values."""
