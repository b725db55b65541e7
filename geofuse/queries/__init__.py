"""Every query of the library with its SQL twin."""

from geofuse.queries import cloud, files, flood, folders, geo, more, sfm, solved, streams, surface, text  # noqa: F401
from geofuse.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
