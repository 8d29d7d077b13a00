"""All registered queries of the library's own operators."""

from agentmeter.plans import attribution, kept, live, logs, requests, rollup, runs, steps, transcripts, trust  # noqa: F401  they register their queries
from agentmeter.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
