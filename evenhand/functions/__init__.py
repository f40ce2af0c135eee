from evenhand.functions import expr, special  # noqa: F401
