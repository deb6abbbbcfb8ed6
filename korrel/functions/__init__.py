from korrel.functions.predicates import custom, equals, less
from korrel.functions.values import as_double, parse

__all__ = ["as_double", "custom", "equals", "less", "parse"]
