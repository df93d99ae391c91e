"""The expression language: Python-syntax expressions compiled to columns."""

from .compiler import Compiler, ExpressionError, Value, literal

__all__ = ["Compiler", "ExpressionError", "Value", "literal"]
