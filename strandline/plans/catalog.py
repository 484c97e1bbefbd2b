"""All registered queries."""

from . import q_sources, q_silver, q_gold, q_relate, q_backtest, q_regress, q_validate, q_audit  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
