"""Registered queries; importing this package registers all of them."""

from . import batching, continuous, features, graph, metrics, partitioning, sampling  # noqa: F401
from .common import QUERIES, SQL  # noqa: F401
