"""Transaction-graph tracing on Spark DataFrames."""

from .params import Params

__all__ = ["Params"]
