"""Queries of the engine. Importing this package registers them all."""

from . import registry  # noqa: F401  isort: skip
from . import corpora, graph, records, semantics, states  # noqa: F401
from . import programs  # noqa: F401  isort: skip
