"""Scalar building blocks: column expressions and Arrow-batched alignment helpers."""
