"""Trees of linked nodes, and flows that evaluate expressions over them."""

from .flow import Flow
from .tree import Node, Relationship, Tree

__all__ = ["Flow", "Node", "Relationship", "Tree"]
