"""Column functions: every one builds a JVM-side expression."""
