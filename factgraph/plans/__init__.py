"""The queries; importing the modules registers them."""

from factgraph.plans import basics, change, graph, overview  # noqa: F401
