"""The four-step text workflow over one input column, as one projection (one scan, one stage)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from gridweave.functions.text import base64_text, caesar, md5_text, rot13


def text_fanout(df: DataFrame, text: str, keys: Sequence[str], shift: int = 3) -> DataFrame:
    """``keys..., caesar, base64, md5, rot13`` of ``text`` - four independent steps."""
    return df.select(*keys, caesar(text, shift).alias("caesar"), base64_text(text).alias("base64"),
                     md5_text(text).alias("md5"), rot13(text).alias("rot13"))
