"""Column functions: every rule here is a JVM expression, none is a Python UDF."""
