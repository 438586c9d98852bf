"""Column expressions; all of them stay on the JVM side."""
