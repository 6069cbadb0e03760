"""Operators for building language-model training corpora (one module per operator)."""
