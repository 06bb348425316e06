"""Column builders: text, time and vector expressions that stay inside the JVM."""
