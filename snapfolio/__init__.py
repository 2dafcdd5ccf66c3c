"""snapfolio: versioned JSON payloads of financial data as Spark DataFrames."""

from snapfolio.catalog import CATALOG, DatasetSpec, Field, spec_for

__all__ = ["CATALOG", "DatasetSpec", "Field", "spec_for"]
