"""All registered queries of the engine's own operators."""

from . import evaluation, graph, relational, studies  # noqa: F401, I001
from . import records  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
