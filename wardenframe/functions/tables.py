"""Table functions for SQL, registered in a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from wardenframe.operators.retrieval import CHUNK_OVERLAP, CHUNK_SIZE, WHITE_SPACE


@udtf(returnType="chunk_id int, text string", useArrow=True)
class Chunks:
    """``chunks(text, size, overlap)``: the numbered chunks of ``retrieval.chunk_documents``, one text at a time."""

    def eval(self, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Iterator[tuple[int, str]]:
        if overlap >= size:
            raise ValueError("overlap must be smaller than size")
        body = (text or "").strip(WHITE_SPACE)
        step, number = size - overlap, 0
        for start in range(0, max(len(body) - overlap, 1) if body else 0, step):
            chunk = body[start: start + size].strip(WHITE_SPACE)
            if chunk:
                yield number, chunk
                number += 1


def register_tables(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    spark.udtf.register("chunks", Chunks)
