"""Readers and writers."""

from lumenrank.sources.items import *  # noqa: F401,F403
from lumenrank.sources.sinks import *  # noqa: F401,F403
from lumenrank.sources.snapshots import (  # noqa: F401
    Snapshot, read_snapshot, snapshot_versions, write_snapshot,
)
from lumenrank.sources.tables import *  # noqa: F401,F403
