from .time import HOUR, hour_of
from . import predicates

__all__ = ["HOUR", "hour_of", "predicates"]
