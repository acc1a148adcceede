"""All queries of the library."""

from siftline.plans import alerts, filesets, imports, inventory, library, queries, relabelling, runs, scalars, stored  # noqa: F401
from siftline.plans.registry import QUERIES, SQL  # noqa: F401
