"""Column expressions and argument checks; everything here stays JVM-side."""
