"""mercato: marketplace analytics reports as Spark DataFrame plans.

Every report is a function ``(Tables, **params) -> DataFrame`` built from
built-in Spark expressions only, so Catalyst can prune, push down and plan
the joins and aggregations for the cluster it runs on.
"""

from mercato.sources.model import Tables, read_marketplace
from mercato.sources.binding import bind_star
from mercato.session import build_session

__all__ = ["Tables", "read_marketplace", "bind_star", "build_session"]
