"""Connected components and disjoint sets, as the engine's graphs use them."""

from tessella.operators.components import BLOCK, Forest, components

__all__ = ["BLOCK", "Forest", "components"]
