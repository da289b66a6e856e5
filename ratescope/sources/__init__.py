from ratescope.sources.columnar import clustered, read_columnar, scan_columns, scan_period, write_columnar
from ratescope.sources.delimited import (
    read_delimited_strict,
    read_periods,
    standardize_types,
    union_periods,
)
from ratescope.sources.sinks import write_cube_json, write_table

__all__ = [
    "clustered",
    "read_columnar",
    "read_delimited_strict",
    "read_periods",
    "scan_columns",
    "scan_period",
    "standardize_types",
    "union_periods",
    "write_columnar",
    "write_cube_json",
    "write_table",
]
