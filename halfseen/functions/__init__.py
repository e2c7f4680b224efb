"""Column expressions: all JVM-side, all usable inside whole-stage codegen."""
