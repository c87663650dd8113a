"""General DataFrame operators."""

from millrace.operators.profile import numeric_profile

__all__ = ["numeric_profile"]
