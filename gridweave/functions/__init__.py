"""Column expressions: every function takes and returns a ``pyspark.sql.Column``."""

from gridweave.functions.lfn import (
    input_query,
    lfn_location,
    lfn_upper,
    normalize_lfn,
    target_name,
)
from gridweave.functions.text import base64_text, caesar, md5_text, rot13, short_id

__all__ = [
    "normalize_lfn", "lfn_location", "lfn_upper", "input_query", "target_name",
    "caesar", "base64_text", "md5_text", "rot13", "short_id",
]
