"""End-to-end compositions of the operators."""

from lumenrank.plans.library import *  # noqa: F401,F403
from lumenrank.plans.sessions import rate_votes, ratings_after, vote_progress, votes_after  # noqa: F401
