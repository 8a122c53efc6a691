"""Relational operators that Spark lacks or that need care at scale."""

from .aggregates import grouping_sets, salted_count_distinct
from .joins import as_of_join, range_join
from .quantiles import exact_quantiles
from .ranks import top_per_group
from .time_windows import sessions, sliding, tumbling

__all__ = ["as_of_join", "exact_quantiles", "grouping_sets", "range_join", "salted_count_distinct", "sessions", "sliding", "top_per_group", "tumbling"]
