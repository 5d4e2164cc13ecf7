"""All queries, by area."""

from . import q_attack, q_chain, q_features, q_metrics, q_models, q_quality, q_reports, q_select, q_stats, q_stream  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
