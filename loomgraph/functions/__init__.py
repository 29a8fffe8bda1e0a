from .exprs import *  # noqa: F403
