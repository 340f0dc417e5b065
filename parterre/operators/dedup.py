"""Repeated requests: within a time of an accepted one, the same request is answered by it instead of being passed on.

Whether a request is accepted depends on the accepted one before it, so this is a
fold in time order: Spark deals the rows out by key and sorts them, and one pass
carries the last accepted request of the key at hand. A key of any number of rows
needs that one value; its rows are sorted on disk where they don't fit.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parterre.operators.fold import _new_keys

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What makes two requests the same, and for how long.
SAME = ["user_id", "event_id", "section"]
WITHIN = dt.timedelta(hours=1)


def repeated_requests(requests: DataFrame, same: list[str] = SAME, within: dt.timedelta = WITHIN) -> DataFrame:
    """``requests`` with ``accepted``, and ``answered_by``: the id of the accepted request (its own, if it is accepted).

    In order of ``ts`` and reservation_id. Requests with equal null keys are the same.
    """
    arranged = requests.repartition(F.xxhash64(*same)).sortWithinPartitions(*same, "ts", "reservation_id")
    schema = T.StructType([*requests.schema, T.StructField("accepted", T.BooleanType()), T.StructField("answered_by", T.StringType())])
    return arranged.mapInArrow(_judge(same, within // dt.timedelta(microseconds=1)), schema)


def _judge(same: list[str], within: int) -> Callable:
    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = last = answer = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            at = batch.column("ts").cast(pa.timestamp("us")).cast(pa.int64()).to_numpy(zero_copy_only=False)
            ids = batch.column("reservation_id").to_pylist()
            keys_at = lambda i: tuple(batch.column(k)[i].as_py() for k in same)
            new = _same_as_before(batch, same, keys_at(0) == key)
            accepted, answers = np.ones(n, bool), list(ids)
            for i in np.flatnonzero(~new).tolist():
                if i and new[i - 1]:
                    last, answer = at[i - 1], ids[i - 1]
                if at[i] - last >= within:
                    last, answer = at[i], ids[i]
                else:
                    accepted[i], answers[i] = False, answer
            key = keys_at(n - 1)
            if new[n - 1]:
                last, answer = at[n - 1], ids[n - 1]
            names = batch.schema.names + ["accepted", "answered_by"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(accepted), pa.array(answers, pa.string())], names)
    return judge


def _same_as_before(batch: pa.RecordBatch, same: list[str], follows: bool) -> np.ndarray:
    """Where a row's key is another than that of the row before it; nulls are equal."""
    filled = pa.RecordBatch.from_arrays(
        [pc.coalesce(batch.column(k).cast(pa.string()), pa.scalar("\0")) for k in same], same)
    return _new_keys(filled, same, follows)
