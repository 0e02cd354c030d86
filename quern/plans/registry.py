"""All queries of the core with their SQL."""

from quern.plans import metrics, sets, sources, stats, tables  # noqa: F401
from quern.plans.base import QUERIES, SQL  # noqa: F401
