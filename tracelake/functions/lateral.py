"""Table functions for SQL: rows from a line's structured data, and from a blob's files.

After ``register``, ``SELECT ... FROM lines, LATERAL structured_data(lines.value)`` joins each line with its
parameters. A value without any gives no rows, so a line stays only under LEFT JOIN LATERAL.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from tracelake.operators import binary

# The shapes of an element and of a parameter.
_ELEMENT, _PARAMETER = re.compile(r"\[([^\s=\]]+)((?:\s+[^\]]+)?)\]"), re.compile(r'([^\s=\[]+)="([^"]*)"')


@udtf(returnType="element string, name string, value string")
class StructuredData:
    """A row a parameter; of a repeated element or name the last counts, as in sources.logs.structured_data."""

    def eval(self, text: str) -> Iterator[tuple[str, str, str]]:
        found = {element: dict(_PARAMETER.findall(rest)) for element, rest in _ELEMENT.findall(text or "")}
        for element, pairs in found.items():
            for name, value in pairs.items():
                yield element, name, value


@udtf(returnType="at long, size long, format string, sha256 string, valid boolean, anomaly double, note string")
class Carved:
    """A row a file found in a blob, as binary.carve has them."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        content = bytes(content or b"")
        for at, end, s in binary.scan(content):
            data = content[at:end]
            yield at, end - at, s.name, hashlib.sha256(data).hexdigest(), *binary.validate(data, s.name, content[end : end + 4096])


def register(spark: SparkSession) -> None:
    """Names the functions structured_data and carved in a session."""
    spark.udtf.register("structured_data", StructuredData)
    spark.udtf.register("carved", Carved)
