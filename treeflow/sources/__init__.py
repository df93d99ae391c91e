"""Sources and sinks: constructors, wide Parquet tensors, spec files, stores and archives of table blocks."""

from .construct import construct, from_arrow, from_labels, one_based, zero_based
from .spec import read_spec
from .store import DataStore, ReadOnlyError
from .wide import from_matrices, from_parquet_3d

__all__ = ["DataStore", "ReadOnlyError", "construct", "from_arrow", "from_labels", "from_matrices", "from_parquet_3d", "one_based", "read_spec", "zero_based"]
