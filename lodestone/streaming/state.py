"""Vote weights, and counts of the votes that stand, as streams over a keyed state store.

Two stateful operators follow each other. The first is keyed by conversation and target and knows every chunk that a target has
ever cited, so that a new vote reaches all of them; the second is keyed by conversation and chunk and holds the chunk's weight, and
for each target the weight that its first vote found. State is kept in RocksDB, entry by entry: a batch reads and writes the
entries of the keys that it holds, whatever the size of the rest, and a restart goes on from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.feedback import Votes, summary_of_changes

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_REACHED = "conversation_id string, chunk_id string, line_no long, target string, thumb string, cites boolean"
UPDATE = "conversation_id string, chunk_id string, line_no long, weight double"


class Reach(StatefulProcessor):
    """Passes a target's votes on to every chunk that it has cited so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.cited = handle.getMapState("cited", "chunk_id string", "line_no long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        known = {k[0] for k in self.cited.keys()} if self.cited.exists() else set()
        for row in sorted(rows, key=lambda r: r.line_no):
            own = set(row.cited_chunk_ids or ())
            for chunk in sorted(own - known):
                self.cited.updateValue((chunk,), (row.line_no,))
            known |= own
            for chunk in sorted(known):
                yield Row(conversation_id=key[0], chunk_id=chunk, line_no=row.line_no, target=key[1], thumb=row.thumb, cites=chunk in own)

    def close(self) -> None:
        pass


class _Kept(dict):
    """The weights that targets' first votes found, read from the state when asked for and written when new."""

    def __init__(self, state) -> None:
        super().__init__()
        self.state = state

    def __contains__(self, target) -> bool:
        if not super().__contains__(target) and self.state.containsKey((target,)):
            super().__setitem__(target, self.state.getValue((target,))[0])
        return super().__contains__(target)

    def setdefault(self, target, weight):
        if target not in self:
            self.state.updateValue((target,), (weight,))
            super().__setitem__(target, weight)
        return self[target]


class Fold(StatefulProcessor):
    """The vote fold of a chunk in a conversation; its weight after a batch is a row."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.weight = handle.getValueState("weight", "weight double")
        self.kept = handle.getMapState("kept", "target string", "weight double")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        votes = Votes(self.weight.get()[0] if self.weight.exists() else None, _Kept(self.kept))
        line = None
        for row in sorted(rows, key=lambda r: r.line_no):
            votes.apply(row.target, row.thumb, row.cites)
            line = row.line_no
        if votes.weight is not None and line is not None:
            self.weight.update((votes.weight,))
            yield Row(conversation_id=key[0], chunk_id=key[1], line_no=line, weight=votes.weight)

    def close(self) -> None:
        pass


def stateful_weights(events: DataFrame) -> DataFrame:
    """(conversation_id, chunk_id, line_no, weight): the new weight of every chunk that a batch of votes reaches.

    Within a batch votes apply in log order; a batch must not hold votes older than those before it. The session's state store is set to RocksDB.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.where("feedback_type = 'citation'").select("conversation_id", "target", "line_no", "thumb", "cited_chunk_ids")
    reached = rows.groupBy("conversation_id", "target").transformWithState(Reach(), _REACHED, "Append", "None")
    return reached.groupBy("conversation_id", "chunk_id").transformWithState(Fold(), UPDATE, "Append", "None")


def latest_weights(spark: SparkSession, path: str) -> DataFrame:
    """(conversation_id, chunk_id, weight) after all updates that a file sink has written to ``path``."""
    rows = spark.read.schema(UPDATE).parquet(path)
    return rows.groupBy("conversation_id", "chunk_id").agg(F.max_by("weight", "line_no").alias("weight"))


CHANGE = "feedback_type string, thumb string, timestamp long, n int"


class Change(StatefulProcessor):
    """What a target's new votes change: the vote that stood is taken back, the last one stands. Votes older than that are passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "line_no long, thumb string, timestamp long")

    def handleInputRows(self, key, rows, timer_values) -> Iterator[Row]:
        held = self.last.get() if self.last.exists() else None
        new = max(rows, key=lambda r: r.line_no)
        if held is not None and held[0] >= new.line_no:
            return
        if held is not None:
            yield Row(feedback_type=key[0], thumb=held[1], timestamp=held[2], n=-1)
        self.last.update((new.line_no, new.thumb, new.timestamp))
        yield Row(feedback_type=key[0], thumb=new.thumb, timestamp=new.timestamp, n=1)

    def close(self) -> None:
        pass


def standing_changes(events: DataFrame) -> DataFrame:
    """(feedback_type, thumb, timestamp, n): votes that come to stand (n = 1) and votes that no longer do (n = -1), a target's last vote being the one that stands.

    Sums of n are the counts over latest votes, in any window of event time: ``feedback.summary_of_changes`` makes the board of them. A batch
    writes at most two rows for each of its targets; votes that come late by their line are passed over, as the log's order decides.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rows = events.select("feedback_type", "conversation_id", "target", "line_no", "thumb", "timestamp")
    return rows.groupBy("feedback_type", "conversation_id", "target").transformWithState(Change(), CHANGE, "Append", "None")


def activity(spark: SparkSession, path: str, now: Column) -> DataFrame:
    """The board from the changes that a file sink has written to ``path``."""
    return summary_of_changes(spark.read.schema(CHANGE).parquet(path), now)
