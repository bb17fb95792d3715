"""sparkdesk: everyday data-desk work as Spark DataFrame operators.

Each operator is a plain function over DataFrames built from Spark SQL
expressions, windows, joins and aggregations, so Catalyst plans it and the
work spreads over the cluster.  See README.md for the module map.
"""

from sparkdesk.session import get_session, scratch_dir

__all__ = ["get_session", "scratch_dir"]
