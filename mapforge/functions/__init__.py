"""Scalar functions: columns in, a column out. numpy companions are in geometry."""
