"""Tables written to the folder that the cluster shares, to cut lineage; see ``sources.tables``."""

from ..sources.tables import discard, shared_dir, written

__all__ = ["discard", "shared_dir", "written"]
