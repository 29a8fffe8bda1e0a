from .graph import Graph
from .patch import Patch, apply_patch, diff

__all__ = ["Graph", "Patch", "apply_patch", "diff"]
