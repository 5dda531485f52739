"""Every query by name, and the SQL it is compared with where SQL can state it."""

from .plans import aggregation, folding, joining, ranking, reading, rules, series, texts, vectors  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
