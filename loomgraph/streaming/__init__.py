from .reconcile import Reconciler, demo_tick
from .serve import Session

__all__ = ["Reconciler", "Session", "demo_tick"]
