"""Scalar functions: normalizers and string similarity."""
