"""Structured Streaming operators."""

from lumenrank.streaming.items import *  # noqa: F401,F403
from lumenrank.streaming.keyed import KeyedRuns  # noqa: F401
from lumenrank.streaming.votes import *  # noqa: F401,F403
