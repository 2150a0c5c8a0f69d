"""Small pieces of SQL text."""

from __future__ import annotations


def num(x: float) -> str:
    """A DOUBLE literal that Spark and DuckDB read alike."""
    text = repr(float(x))
    text = text if "e" in text else text + "e0"
    return f"({text})" if text.startswith("-") else text


def polynomial(coefficients, q: str) -> str:
    """Horner form; coefficients ascend."""
    terms = [float(c) for c in coefficients]
    out = num(terms[-1])
    for c in reversed(terms[:-1]):
        out = f"({out} * {q} + {num(c)})"
    return out


def total(parts: list[str]) -> str:
    return " + ".join(parts) if parts else "0e0"
