"""Column-expression helpers (all JVM-side built-ins, no Python UDFs)."""

from .columns import (drop_last_char, flag, iso_weekday, prefix_event, ratio,
                      lead_days)

__all__ = ["flag", "iso_weekday", "prefix_event", "drop_last_char", "ratio",
           "lead_days"]
