"""All registered queries."""

from . import q_aggs, q_docs, q_graph, q_joins, q_misc, q_rules, q_stream, q_windows  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
