"""All registered queries."""

from siftwell.plans import ingesting, quality, retrieval, streams, usage  # noqa: F401
from siftwell.plans.registry import QUERIES, SQL  # noqa: F401
