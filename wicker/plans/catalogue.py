"""All queries of the library and their SQL twins."""

from . import docs, server, star

MODULES = (star, docs, server)
QUERIES: dict = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in MODULES for k, v in m.ORACLES.items()}
