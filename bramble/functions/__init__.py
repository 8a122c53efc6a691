"""Column functions; all stay in the JVM."""

from .columns import cents, cosine, json_number, money, norm

__all__ = ["cents", "cosine", "json_number", "money", "norm"]
