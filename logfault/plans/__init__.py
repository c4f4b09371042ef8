from .base import ORACLE, QUERIES
from . import q_tables, q_scalars, q_joins, q_aggregates, q_windows, q_text, q_learning, q_stages  # noqa: F401  (registration)

__all__ = ["ORACLE", "QUERIES"]
