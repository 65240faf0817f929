"""Structured Streaming: catalog stream, new-entry dedup, stateful grouping and zipping, job sink."""

from gridweave.streaming.grouping import (
    catalog_stream,
    stream_fixed_groups,
    stream_fixed_groups_batched,
    stream_new_entries,
    stream_zip_groups,
    stream_zip_groups_batched,
)
from gridweave.streaming.jobs import run_to_table, stream_jobs
from gridweave.streaming.seen import stream_new_entries_batched

__all__ = ["catalog_stream", "stream_new_entries", "stream_new_entries_batched", "stream_fixed_groups", "stream_fixed_groups_batched",
           "stream_zip_groups", "stream_zip_groups_batched",
           "stream_jobs", "run_to_table"]
