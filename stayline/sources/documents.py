"""Document collections (images, notes, embeddings) linked to encounters by a text key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY_COLUMNS = ("postgres_encounter_id", "encounter_id")


def link_documents(documents: DataFrame) -> DataFrame:
    """Replace the text key by a numeric ``encounter_id``; text that is no number becomes NULL."""
    key = next(c for c in KEY_COLUMNS if c in documents.columns)
    rest = [F.col(c) for c in documents.columns if c != key]
    return documents.select(F.col(key).try_cast("bigint").alias("encounter_id"), *rest)


def find_documents(documents: DataFrame, encounters: DataFrame | None = None, **equals) -> DataFrame:
    """Documents of the given encounters with the given attribute values (modality, note_type, ...)."""
    found = link_documents(documents)
    for column, value in equals.items():
        found = found.where(F.col(column) == value)
    return found if encounters is None else found.join(encounters.select("encounter_id"), "encounter_id", "left_semi")
