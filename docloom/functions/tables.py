"""Table functions for SQL: ``select ... from docs, lateral chunk(text, summary)``."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import LongType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from docloom.functions.text import TOKEN

#: Limits of chunks, in tokens.
MOST, OVERLAP = 600, 60
_TOKEN = re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), TOKEN)


@dataclass
class Limits(AnalyzeResult):
    """What ``analyze`` has read from the call, for the rows' ``eval``."""

    most: int = MOST
    overlap: int = OVERLAP


def _paragraphs(text: str) -> list[str]:
    """As ``chunking.paragraphs``."""
    parts = text.split("\n\n") if "\n\n" in text else text.split("\n")
    return [p for p in (x.strip(" ") for x in parts) if p]


class Chunk:
    """``chunk(text [, summary] [, most => 600] [, overlap => 60])``: the rows of
    ``chunking.chunk_documents`` for one document.

    The limits are constants and checked when the query is analysed; a null text has no
    chunks, an empty summary is none."""

    def __init__(self, limits: Limits):
        self.most, self.overlap = limits.most, limits.overlap
        self.tokens = re.compile(_TOKEN)

    @staticmethod
    def analyze(text: AnalyzeArgument, summary: AnalyzeArgument | None = None, most: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> Limits:
        for name, arg in (("text", text), ("summary", summary)):
            if arg is not None and (arg.isTable or not (isinstance(arg.dataType, StringType) or arg.dataType.typeName() == "void")):
                raise ValueError(f"chunk: {name} must be a string")
        limits = {"most": MOST, "overlap": OVERLAP}
        for name, arg in (("most", most), ("overlap", overlap)):
            if arg is not None:
                if not arg.isConstantExpression or not isinstance(arg.value, int) or arg.value < 0:
                    raise ValueError(f"chunk: {name} must be a constant of at least 0")
                limits[name] = arg.value
        schema = StructType().add("sequence_number", LongType()).add("content", StringType()).add("chunk_type", StringType()).add("token_count", LongType())
        return Limits(schema=schema, **limits)

    def _count(self, text: str) -> int:
        return sum(1 for _ in self.tokens.finditer(text))

    def eval(self, text: str, summary: str | None = None, most: int | None = None, overlap: int | None = None) -> Iterator[tuple]:
        if summary:
            yield -1, summary, "summary", self._count(summary)
        number, held, n = 0, [], 0
        for part in _paragraphs(text or ""):
            size = self._count(part)
            table = part.startswith("|")
            if held and (table or n + size > self.most):
                yield number, "\n\n".join(p for p, _ in held), "text", n
                number += 1
                kept: list[tuple[str, int]] = []
                # the longest run of last paragraphs that the overlap has room for
                while not table and held and sum(c for _, c in kept) + held[-1][1] <= self.overlap:
                    kept.insert(0, held.pop())
                held, n = kept, sum(c for _, c in kept)
            if table:
                yield number, part, "table", size
                number += 1
            else:
                held.append((part, size))
                n += size
        if held:
            yield number, "\n\n".join(p for p, _ in held), "text", n


def register(spark: SparkSession) -> None:
    """Make ``chunk`` known to the session's SQL."""
    spark.udtf.register("chunk", udtf(Chunk))
