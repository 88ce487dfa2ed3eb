"""The registered queries and their SQL checks."""

from threadlens.suite import features, io_text, relational, rules, sampling, triage  # noqa: F401
from threadlens.suite.base import ORACLES, QUERIES  # noqa: F401
