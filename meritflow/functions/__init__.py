"""Column-expression builders (all JVM-side built-ins, no Python UDFs)."""
