"""Scalar expressions and SQL text shared by engine and checks."""
