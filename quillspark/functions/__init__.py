"""Column -> Column builders (pure expressions, whole-stage codegen friendly)."""
