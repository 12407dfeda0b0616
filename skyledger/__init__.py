"""skyledger — airline booking and operations analytics as Spark DataFrame jobs.

Every operator is a lazy ``DataFrame -> DataFrame`` function over whole tables,
takes an explicit ``as_of`` timestamp instead of reading the wall clock, and
leaves physical planning (join strategy, pushdown, partial aggregation) to
Catalyst and AQE.
"""

from skyledger.session import get_session, checkpoint_dir  # noqa: F401
from skyledger.sources.views import airline_views, Tables  # noqa: F401

__all__ = ["get_session", "checkpoint_dir", "airline_views", "Tables"]
