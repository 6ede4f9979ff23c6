"""Registered queries over the driver tables, with their SQL."""

from tidewell.plans import corpus, cycles, index, records, sync, telemetry

QUERIES = cycles.QUERIES | corpus.QUERIES | index.QUERIES | records.QUERIES | sync.QUERIES | telemetry.QUERIES
ORACLES = cycles.ORACLES | corpus.ORACLES | index.ORACLES | records.ORACLES | sync.ORACLES | telemetry.ORACLES
