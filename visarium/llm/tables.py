"""Tables that cut a lineage, as everywhere in the engine."""

from visarium.tables import delete, scope, shared_dir, stored

__all__ = ["delete", "scope", "shared_dir", "stored"]
