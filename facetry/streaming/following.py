"""Following a published index: a stream over its pointers that swaps versions and reloads formats by difference."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from facetry.engine import Engine
from facetry.sources.store import POINTER


def follow(engine: Engine, checkpoint: str, formats: str | None = None, told: Callable[[int, list[str]], None] | None = None, once: bool = False) -> StreamingQuery:
    """Starts a stream over the pointers below the engine's root. A batch of new pointers makes the engine take the newest
    version, and re-read the list of ``formats``, of which those that didn't change stay resolved. ``told`` gets the version
    and the changed formats. ``once`` stops when all pointers that exist are seen; else the stream polls. A restart from
    ``checkpoint`` sees each pointer once; a batch that is repeated finds nothing newer."""
    pointers = engine.spark.readStream.schema(POINTER).json(f"{engine.root}/pointer")

    def seen(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        engine.refresh()
        changed = engine.refresh_formats(formats) if formats else []
        if told:
            told(engine.version, changed)

    writer = pointers.writeStream.foreachBatch(seen).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
