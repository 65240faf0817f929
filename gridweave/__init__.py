"""gridweave: the data work around file-based production campaigns, as Spark DataFrame operators.

Sub-packages
------------
sources    readers and writers (catalog, points, parameter documents, text outputs, fallback sinks)
functions  column expressions (LFN handling, text transforms, JSON output parsing)
operators  DataFrame -> DataFrame operators (catalog, grouping, jobs, refs, outputs, registry, ...)
plans      the registered queries over the driver tables and their SQL oracles
streaming  Structured Streaming versions of grouping and job creation
"""

from gridweave.session import checkpoint_dir, get_spark

__all__ = ["get_spark", "checkpoint_dir"]
