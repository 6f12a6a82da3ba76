"""The engine's functions for SQL sessions."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def register(spark: SparkSession) -> None:
    """Register ``chunk_text(stem, body, chars, overlap)`` and ``page_lines(html)`` as table functions and ``embed_text(text)``."""
    from lodestone.operators import chunking, collect
    from lodestone.operators.models import OfflineClient

    class ChunkText:
        def eval(self, stem: str, body: str, chars: int, overlap: int):
            for n, (title, text) in enumerate(chunking.chunks_of(body or "", chars, overlap)):
                yield f"{stem}__{n}", title, text

    class PageLines:
        def eval(self, html: str):
            for n, line in enumerate(collect.page_lines(collect.tree(html or ""))):
                yield n, line

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = OfflineClient()
        for texts in batches:
            yield pd.Series(list(client.embed(texts.fillna("").tolist())), dtype=object)

    spark.udtf.register("chunk_text", F.udtf(ChunkText, returnType="chunk_id string, section_title string, text string"))
    spark.udtf.register("page_lines", F.udtf(PageLines, returnType="position int, line string"))
    spark.udf.register("embed_text", F.pandas_udf(embed, "array<float>", functionType=F.PandasUDFType.SCALAR_ITER))
