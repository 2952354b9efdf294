"""Connected components of a link table, without collecting links or labels anywhere."""

from __future__ import annotations

from lumenlake.operators.components import LocalForest, components

__all__ = ["LocalForest", "components"]
