"""Column functions: text, statistics and decisions. All run inside the JVM."""
