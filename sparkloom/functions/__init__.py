"""Scalar building blocks: every one a Column expression, so plans stay inside the JVM."""
