"""Column expressions (JVM-side; no per-row Python)."""
