"""The registered queries and their SQL."""

from tallyloom.plans import civic, evidence, more, publishing, registry, relational, study, texts  # noqa: F401

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES
