"""Column builders: JVM-side expressions that compose with any DataFrame."""
