from .registry import REGISTRY, Analytic, analytics, register

__all__ = ["REGISTRY", "Analytic", "analytics", "register"]
