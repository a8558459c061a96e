"""A vector and metadata search engine on Spark."""

from vectorframe.api import Api
from vectorframe.engine import Engine

__all__ = ["Api", "Engine"]
