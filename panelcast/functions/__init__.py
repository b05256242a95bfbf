"""Scalar Column functions (JVM-side expressions)."""
