"""Column expressions shared by the operators; all of them run inside the JVM."""
