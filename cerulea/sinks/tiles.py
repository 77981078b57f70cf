"""Bytes of tiles kept as files, one a tile, under names made of their place and address."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cerulea.functions.text import cache_key, tile_url


def keep_tiles(images: DataFrame, folder: str, template: str, content: str = "png") -> int:
    """Writes the bytes of each row (z, tx, ty and ``content``) to ``folder``, an address that pyarrow can open or a path, and tells how many files there were.

    A file is written under another name and then moved, and its name follows from the tile alone: a reader never sees half of one, and a task that runs twice writes the
    same files. Of rows that repeat a tile, one stays. A tile without bytes (null or empty) is not kept, so it is still one to fetch.
    """
    z, x, y = (F.col(c) for c in ("z", "tx", "ty"))
    rows = images.where(F.length(content) > 0).select(cache_key(z, x, y, tile_url(template, z, x, y)).alias("name"), F.col(content).alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        for batch in batches:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as out:
                    out.write(body)
                system.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return rows.mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
