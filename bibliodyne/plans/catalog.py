"""All registered queries of the library."""

from bibliodyne.plans import graph, relational, sinks, streams, texts, vectors  # noqa: F401
from bibliodyne.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
