"""All registered queries."""

from proratio.plans import cells, checks, model, pricing  # noqa: F401
from proratio.plans.registry import ORACLES, QUERIES  # noqa: F401
