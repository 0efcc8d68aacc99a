"""Components of links; the method is the core's own."""

from ..operators.components import linked_roots

__all__ = ["linked_roots"]
