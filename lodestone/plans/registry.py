"""All queries and oracles by name."""

from lodestone.plans import basics, exchange, graphs, learning, making, places, text

QUERIES = {}
ORACLES = {}
for module in (basics, text, graphs, places, learning, exchange, making):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES
