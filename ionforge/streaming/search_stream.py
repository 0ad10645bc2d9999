"""An optional stream of spectra: new files are searched as they come.

The false discovery rate is global, so it is not part of the stream; candidates
and scores are stored for each batch and filtered afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans import pipeline
from ..plans.config import SearchConfig
from ..sources import store


def start(spectra: DataFrame, db: DataFrame, config: SearchConfig, path: str, checkpoint: str, embedder=None) -> StreamingQuery:
    """Search and rescore each batch of a streaming ``spectra`` and store the result under ``path``."""

    def batch(df: DataFrame, _: int) -> None:
        ready = pipeline.prepare_spectra(df, config)
        store.put(pipeline.rescore(ready, pipeline.search(ready, db, config, embedder), config), path)

    return spectra.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
