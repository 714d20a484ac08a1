"""Column-level functions; everything here stays inside JVM code generation."""
