"""Query catalogue over the test tables: each query with the SQL that must give the same rows."""

from trajlake.plans.catalog import ORACLES, QUERIES


def load() -> None:
    """Import every catalogue module."""
    from trajlake.plans import (  # noqa: F401
        advantage, assembly, episodes, grading, messages, metrics, prep, runlog, server, shape, sources, streams, text, toolcalls,
    )


__all__ = ["ORACLES", "QUERIES", "load"]
