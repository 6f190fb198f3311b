"""Joins with tables of ids whose size is checked before they are sent."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of ids, 8 bytes each, up to which a table is sent to all executors; a larger one is joined by shuffles.
SENT_ROWS = 2_000_000


def sent(narrow: DataFrame, most: int = SENT_ROWS) -> DataFrame:
    """`narrow` (a stored table of a few numbers a row), to be sent to all tasks if it has `most` rows or fewer; else it is joined in the common way."""
    return F.broadcast(narrow) if narrow.count() <= most else narrow


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str, null_too: bool = False, most: int = SENT_ROWS) -> DataFrame:
    """`docs` without the rows whose id is in `gone` (stored; one column). null_too: a null in `gone` takes the rows without an id."""
    name = f"_gone_{uuid.uuid4().hex}"  # no column of docs has that name
    ids = sent(gone, most).toDF(name)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(name)) if null_too else F.col(f"`{id_col}`") == F.col(name)
    return docs.join(ids, same, "left_anti")
