"""Column expressions: pure JVM-side building blocks shared by batch and streaming jobs."""
