"""wearhouse: wardrobe catalog and usage analytics on Spark DataFrames.

Every query a catalog application asks for one user at a time is computed
here for all users at once (``u_id`` is an ordinary column, so a single user
is a pushed-down filter).  Tables travel together as :class:`Tables`.
"""

from wearhouse.sources.tables import Tables, load_tables, write_tables
from wearhouse.sources.derive import derive_tables

__all__ = ["Tables", "load_tables", "write_tables", "derive_tables"]
