"""Change logs as streams."""

from weftgraph.streaming.synclog import SyncLogStream

__all__ = ["SyncLogStream"]
