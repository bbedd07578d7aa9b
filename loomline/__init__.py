"""Analytical tables prepared by a graph of versioned modules on Spark."""

from .functions import parse_type
from .operators import Graph, Module, Plan, RunResult, Sandbox, SparkProfile, Workspace, select_as
from .plans import Description, Relation, StateStore, Version, VersionConflict, VersionMismatch
from .sources import Storage
from .streaming import ripple, wave

__all__ = ["Description", "Graph", "Module", "Plan", "Relation", "RunResult", "Sandbox", "SparkProfile", "StateStore", "Storage", "Version", "VersionConflict", "VersionMismatch", "Workspace", "parse_type", "ripple", "select_as", "wave"]
