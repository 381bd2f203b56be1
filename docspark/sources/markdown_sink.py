"""Markdown and verdicts as files."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_markdown(docs: DataFrame, key: str, text: str, path: str, folders: int = 1) -> DataFrame:
    """(key, file): each document in a file of its own, key.md, below a ``path`` that all executors can open.

    The files are dealt to ``folders`` folders by a hash of the key, so that none of them grows too long to be listed. A
    file is written beside its place and moved there, so a task that runs again leaves no half file; of documents
    that repeat a key the last one written stays. Characters that no file name may have become _. Nothing is
    written before the result is used. A null text is an empty file, and a null key is left out.
    """
    import os
    import uuid

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = []
            for name, folder, text_ in zip(batch["name"], batch["folder"], batch["text"]):
                where = os.path.join(path, f"{folder:05d}") if folders > 1 else path
                os.makedirs(where, exist_ok=True)
                file = os.path.join(where, f"{name}.md")
                with open(f"{file}.{uuid.uuid4().hex}", "w", encoding="utf-8", newline="") as out:
                    out.write(text_)
                os.replace(out.name, file)
                files.append(file)
            yield pd.DataFrame({key: batch[key], "file": files})

    rows = docs.where(F.col(key).isNotNull()).select(
        key,
        F.regexp_replace(F.col(key).cast("string"), r"[\\\\/:*?\"<>|\\x00-\\x1F]", "_").alias("name"),
        F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(folders)).cast("int").alias("folder"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return rows.mapInPandas(run, f"{key} {dict(docs.dtypes)[key]}, file string")


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
