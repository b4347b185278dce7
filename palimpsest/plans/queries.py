"""All queries of the library and their SQL: importing the modules registers them."""

from palimpsest.plans import catalogue, extensions, graphs, indexes, records, search, streams, understanding, writes  # noqa: F401
from palimpsest.plans.base import QUERIES, SQL  # noqa: F401
