"""Composite plans: the funnel and the experiment report."""

from adfunnel.plans.funnel import build_funnel, funnel_rows
from adfunnel.plans.report import experiment_report

__all__ = ["build_funnel", "experiment_report", "funnel_rows"]
