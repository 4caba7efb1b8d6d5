"""Scalar functions with the index, rounding and padding rules of the interpreter's library, as Column expressions."""
