"""All registered queries."""

from larkfield.plans import queries_columns  # noqa: F401
from larkfield.plans import queries_lookalike  # noqa: F401
from larkfield.plans import queries_metrics  # noqa: F401
from larkfield.plans import queries_ranking  # noqa: F401
from larkfield.plans import queries_relational  # noqa: F401
from larkfield.plans import queries_sources  # noqa: F401
from larkfield.plans import queries_spatial  # noqa: F401
from larkfield.plans.registry import QUERIES, SQL  # noqa: F401
