"""All registered queries."""

from voxelherd.plans import (  # noqa: F401
    q_curation, q_evaluation, q_packaging, q_participants, q_streaming, q_volumes,
)
from voxelherd.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
