"""Column expressions. Everything here compiles to JVM expressions unless it says otherwise."""
