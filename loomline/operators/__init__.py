"""Modules, workspaces, graphs and sandboxes."""

from .graph import Graph, Plan, RunResult
from .module import Module, select_as
from .sandbox import Sandbox
from .workspace import SparkProfile, Workspace

__all__ = ["Graph", "Module", "Plan", "RunResult", "Sandbox", "SparkProfile", "Workspace", "select_as"]
