from netloom.catalog import (  # noqa: F401
    detect, flows, packets, registry, reports, rules, segments, tables,
)

QUERIES, ORACLES = registry.QUERIES, registry.ORACLES
