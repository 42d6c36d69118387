"""Transaction logs as a stream: the last state of every transaction, kept as its states arrive in any order.

An extension; the batch operators in :mod:`quillspan.operators.journal` define what is right. No event time is involved: a
transaction's state is its rows so far, bounded by the number of states that a log may have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "transaction_id string, states long, last_sequence long, last_state string, complete boolean"
STATE = "sequences array<long>, last_sequence long, last_state string"


def last_states(stream: DataFrame) -> DataFrame:
    """``stream(transaction_id, sequence, global_state)``: an update for each transaction that a batch touches.

    ``complete``: no sequence below the last one is missing. Repeated rows change nothing.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, name = state.get if state.exists else ([], -1, "")
        seen = set(seen)
        for pdf in batches:
            for sequence, global_state in zip(pdf["sequence"], pdf["global_state"]):
                seen.add(int(sequence))
                if sequence >= last:
                    last, name = int(sequence), global_state
        state.update((sorted(seen), last, name))
        yield pd.DataFrame({"transaction_id": [key[0]], "states": [len(seen)], "last_sequence": [last], "last_state": [name], "complete": [last + 1 == len(seen)]})

    return stream.groupBy("transaction_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
