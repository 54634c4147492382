"""Hourly electricity-demand projections and queries over them, on Spark DataFrames."""

from kilocast.client import ProjectionClient
from kilocast.config import ModelParameters, ProjectConfig, Scenario, TableOverride
from kilocast.plans.project import Project

__all__ = [
    "ModelParameters",
    "Project",
    "ProjectConfig",
    "ProjectionClient",
    "Scenario",
    "TableOverride",
]
