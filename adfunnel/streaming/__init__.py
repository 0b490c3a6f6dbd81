"""Hour-by-hour incremental processing of the report."""

from adfunnel.streaming.hourly import (
    catch_up, hourly_report, report_for_hour, report_template, run_hours, written_hours,
)

__all__ = ["catch_up", "hourly_report", "report_for_hour", "report_template", "run_hours",
           "written_hours"]
