"""Sources and sinks: driver tables, appointment files, run-metric files."""

from .tables import read_table
from .appointments import (appointments_from_events, appointments_from_orders,
                           read_appointments)
from .results import read_run_metrics, write_run_metrics

__all__ = ["read_table", "appointments_from_orders", "appointments_from_events",
           "read_appointments", "read_run_metrics", "write_run_metrics"]
