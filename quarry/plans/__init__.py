"""All registered queries of the library proper."""

from . import algebra, configs, expressions, flows, kept, measures, modules, pages, relational, repository, text  # noqa: F401
from .base import QUERIES, SQL  # noqa: F401
