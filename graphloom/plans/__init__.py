"""The driver's tables as a code graph, and the registered queries over them."""

from graphloom.plans import catalogue, symbols

__all__ = ["catalogue", "symbols"]
