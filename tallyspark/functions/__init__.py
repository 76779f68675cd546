"""Column expressions; all of them stay inside the JVM unless the docstring says otherwise."""
