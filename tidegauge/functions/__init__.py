"""Column-level building blocks (no shuffles, whole-stage-codegen friendly)."""
