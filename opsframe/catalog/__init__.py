"""Every operator as a query over the given tables."""

from opsframe.catalog import columns, documents, keyed, normalizing, sales, streams, tables  # noqa: F401
from opsframe.catalog.registry import QUERIES, oracles  # noqa: F401
