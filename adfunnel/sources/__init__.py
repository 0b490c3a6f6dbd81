"""Fact/dimension readers, hour-range scans and the hour-partitioned sink."""

from adfunnel.sources.scan import check_hours, hour_range, read_dims, read_facts, read_table
from adfunnel.sources.sink import write_hour, write_hours

__all__ = ["check_hours", "hour_range", "read_dims", "read_facts", "read_table", "write_hour", "write_hours"]
