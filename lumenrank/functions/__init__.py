"""Column functions; every one compiles to built-in expressions."""

from lumenrank.functions.columns import *  # noqa: F401,F403
