"""Scalar Column builders shared by the operators (all JVM-side expressions)."""
