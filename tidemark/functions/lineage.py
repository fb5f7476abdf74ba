"""Cut a lineage that several later plans share."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidemark.session import ensure_checkpoint_dir


def cut(df: DataFrame) -> DataFrame:
    """Materialise once in the reliable checkpoint folder.

    Used where one expensive frame feeds many jobs (bounds, ranks, audits, models). The copy lives
    in the shared folder, so losing an executor does not lose it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()
