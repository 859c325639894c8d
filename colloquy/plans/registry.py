"""Queries by name, and the SQL of those that SQL can express."""

from colloquy.plans import dashboards, standin, stored

QUERIES = {**standin.QUERIES, **dashboards.QUERIES, **stored.QUERIES}
ORACLES = {**standin.ORACLES, **dashboards.ORACLES, **stored.ORACLES}
