"""Text transforms of the sample payloads (caesar, base64, md5, rot13) and the short-id rule.

All of them are built-in Spark expressions, so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import sys
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridweave.functions._cols import as_col

# The ROT13 alphabet pair (ASCII letters only, as the rot_13 codec does).
ROT13_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
ROT13_TO = "NOPQRSTUVWXYZABCDEFGHIJKLMnopqrstuvwxyzabcdefghijklm"

# Code points of 'a' and 'A', and the alphabet size of the caesar shift.
_LOWER_A = 97
_UPPER_A = 65
_ALPHABET = 26


@lru_cache(maxsize=32)
def caesar_table(shift: int) -> tuple[str, str]:
    """(from, to) strings of the caesar translation for ``shift``, built by rule.

    The rule is applied to every code point Python calls a letter (``str.isalpha``): take the
    first character of its lower-case form, move it ``shift`` places within a..z counted from
    ``ord('a')`` (floor modulo, so non-ASCII letters fold into a..z too), and upper-case the
    result unless the input letter is lower case.  Letters that map onto themselves are left out.
    """
    src: list[str] = []
    dst: list[str] = []
    for cp in range(sys.maxunicode + 1):
        ch = chr(cp)
        if not ch.isalpha():
            continue
        k = (ord(ch.lower()[0]) - _LOWER_A + shift) % _ALPHABET
        out = chr(k + (_LOWER_A if ch.islower() else _UPPER_A))
        if out != ch:
            src.append(ch)
            dst.append(out)
    return "".join(src), "".join(dst)


def caesar(col: Column | str, shift: int) -> Column:
    """Caesar cipher of ``col``: letters shifted within a..z, other characters kept.

    Every character maps independently, so the cipher is one ``translate`` with a table derived
    from the rule in :func:`caesar_table`; no per-character lambda and no Python worker.
    """
    src, dst = caesar_table(int(shift))
    return F.translate(as_col(col), src, dst)


def base64_text(col: Column | str) -> Column:
    """RFC 4648 base64 of the UTF-8 bytes, on one line (Spark chunks at 76 characters)."""
    encoded = F.base64(F.encode(as_col(col), "UTF-8"))
    return F.replace(encoded, F.lit("\r\n"), F.lit(""))


def md5_text(col: Column | str) -> Column:
    """Hex MD5 of the UTF-8 bytes."""
    return F.md5(F.encode(as_col(col), "UTF-8"))


def rot13(col: Column | str) -> Column:
    """ROT13 of ASCII letters; everything else unchanged."""
    return F.translate(as_col(col), ROT13_FROM, ROT13_TO)


def short_id(col: Column | str) -> Column:
    """Last part of an identifier: after the last ``#``, then after the last ``/``."""
    return F.substring_index(F.substring_index(as_col(col), "#", -1), "/", -1)
