"""Column -> Column functions; all but the HTML tree ones stay inside the JVM."""
