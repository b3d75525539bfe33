"""Graph pattern matching on Spark: plans in Python, execution by Catalyst."""

from .api import CompiledPlan, RunResult, compile_plan
from .graph import Graph, MetaData
from .patterns import CATALOGUE, Pattern

__all__ = ["CATALOGUE", "CompiledPlan", "Graph", "MetaData", "Pattern", "RunResult", "compile_plan"]
