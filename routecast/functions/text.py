"""Text functions that Spark has no built-in for."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


@F.arrow_udf(StringType())
def _unicode_key(text: pa.Array) -> pa.Array:
    """One text at a time, so that beside a batch and its keys no more than a few texts are held."""

    def key(t: str | None) -> str | None:
        if t is None:
            return None
        folded = unicodedata.normalize("NFKC", t).casefold().replace("\n", " ")
        # of all white space only the space is printable
        return folded.strip() if folded.isprintable() and "  " not in folded else " ".join(folded.split())

    return pa.array((key(t.as_py()) for t in text), pa.string(), size=len(text))


def normal_key(text: Column) -> Column:
    """P10: NFKC, case folding and single spaces. Plain ASCII texts stay in the JVM's expression; Python, which is given every row, gets nulls for them."""
    plain = F.octet_length(text) == F.char_length(text)
    ascii_key = F.trim(F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " "))
    return F.when(plain, ascii_key).otherwise(_unicode_key(F.when(~plain, text)))


def ascii_key(text: Column) -> Column:
    """Lower case and single spaces, without Python; the same as `normal_key` on plain ASCII texts."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\x0B\f\r]+", " "))
