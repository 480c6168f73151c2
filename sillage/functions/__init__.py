"""Column functions: no DataFrame, no session, all evaluated inside the JVM."""
