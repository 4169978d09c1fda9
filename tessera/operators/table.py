"""Versioned tables: INSERT, DELETE and UPDATE over immutable DataFrames, read by snapshot.

A table is a base, inserted deltas and tombstones (row ids that end), each with the id of the commit
that made it. The driver holds this list under a lock; rows stay distributed. A snapshot is the union
of what its commit sees less the tombstones it sees, by one anti join. Row ids are append-only and never
given again.

A delete conflicts with another open transaction that holds one of its rows, and with commits after its
own transaction began that ended one. Rows that were ended before that are not there any more: to delete
them does nothing. Conflicts are looked for by one job outside the lock, again for what came meanwhile.
"""

from __future__ import annotations

import threading
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import CHUNK_ROWS, chunk_id, chunk_offset
from tessera.sources.parquet import ROW, dense_row_ids, numbered

#: No id, the first id, and the commit id that stands for "not ended".
INVALID_ID, FIRST_ID, NOT_ENDED = 0, 1, 4294967294


class WriteConflict(RuntimeError):
    """Another transaction holds a row that this one wants to delete, or ended it meanwhile."""


class TransactionIds:
    """Ascending ids, given out under a lock."""

    def __init__(self) -> None:
        self._lock, self._next = threading.Lock(), FIRST_ID

    def take(self) -> int:
        with self._lock:
            now, self._next = self._next, self._next + 1
            return now


@dataclass(frozen=True)
class _Delta:
    """Rows visible from commit ``cid`` on; with ``versioned`` they bring ``_tid`` and ``_begin_cid`` along."""

    cid: int
    tid: int
    rows: DataFrame
    count: int
    versioned: bool = False


@dataclass(frozen=True)
class _Ended:
    """Row ids that end with commit ``cid``."""

    cid: int
    tid: int
    row_ids: DataFrame


@dataclass
class Transaction:
    """Pending inserts and deletes of one table; nothing is visible before ``commit``.

    ``start`` is the last commit before it began.
    """

    table: Table
    tid: int
    start: int
    inserts: list[DataFrame] = field(default_factory=list)
    deletes: list[DataFrame] = field(default_factory=list)
    open: bool = True

    def insert(self, source: DataFrame) -> Transaction:
        self.inserts.append(self.table._aligned(source))
        return self

    def conflicts(self, row_ids: DataFrame) -> DataFrame:
        """(row_index, tid): the wanted rows that other open transactions hold, each with its least holder."""
        with self.table._lock:
            held = self.table._held(self)
        return _holders(row_ids, held)

    def delete(self, row_ids: DataFrame) -> Transaction:
        """Lock and end rows (column ``row_index``); all or nothing. Repeated ids count once."""
        wanted = row_ids.select(F.col(ROW).cast("long").alias(ROW)).distinct()
        known: list[tuple[int, DataFrame]] = []
        while True:
            with self.table._lock:
                held = self.table._held(self)
                new = [h for h in held if not any(h[1] is k[1] for k in known)]
                if not new:
                    self.deletes.append(wanted)
                    return self
            found = _holders(wanted, new).first()
            if found is not None:
                raise WriteConflict(f"transaction {found.tid} holds a row")
            known = held

    def commit(self) -> int:
        return self.table._commit(self)

    def rollback(self) -> None:
        self.table._close(self)


def _holders(wanted: DataFrame, held: list[tuple[int, DataFrame]]) -> DataFrame:
    """(row_index, tid) of the wanted rows among those held, with the least tid of each."""
    keys = wanted.select(F.col(ROW).cast("long").alias(ROW))
    if not held:
        return keys.limit(0).withColumn("tid", F.lit(0).cast("long"))
    rows = reduce(DataFrame.union, [r.select(ROW, F.lit(tid).cast("long").alias("tid")) for tid, r in held])
    return rows.join(keys, ROW, "left_semi").groupBy(ROW).agg(F.min("tid").alias("tid"))


class Table:
    """A table whose versions are read by commit id; ``base`` may have ``row_index`` already."""

    def __init__(self, base: DataFrame, ids: TransactionIds | None = None, chunk_rows: int = CHUNK_ROWS):
        self.columns = [c for c in base.columns if c != ROW]
        self.schema = base.select(*self.columns).schema
        self.spark, self.ids, self.chunk_rows = base.sparkSession, ids or TransactionIds(), chunk_rows
        rows = base if ROW in base.columns else dense_row_ids(base)
        self._lock = threading.RLock()
        self._open: dict[int, Transaction] = {}
        self._deltas = [_Delta(0, INVALID_ID, rows.select(*self.columns, ROW), base.count())]
        self._ended: list[_Ended] = []
        self.last_commit, self.oldest = 0, 0

    def _held(self, but: Transaction) -> list[tuple[int, DataFrame]]:
        """The pending deletes of the other open transactions."""
        return [(t.tid, rows) for t in self._open.values() if t is not but for rows in t.deletes]

    def _aligned(self, source: DataFrame) -> DataFrame:
        missing = set(self.columns) - set(source.columns)
        if missing:
            raise ValueError(f"the source lacks {sorted(missing)}")
        order = [ROW] if ROW in source.columns else []
        return source.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], *order)

    def begin(self) -> Transaction:
        with self._lock:
            t = Transaction(self, self.ids.take(), self.last_commit)
            self._open[t.tid] = t
            return t

    def _close(self, t: Transaction) -> None:
        with self._lock:
            self._open.pop(t.tid, None)
            t.open = False

    def _commit(self, t: Transaction) -> int:
        if not t.open:
            raise RuntimeError("the transaction is closed")
        sources = []
        for source in t.inserts:  # row ids of the source fix the order
            sources.append((source, source.count()) if ROW in source.columns else numbered(source))
        wanted = [d.select(ROW, F.lit(t.tid).alias("tid")) for d in t.deletes]
        seen = 0
        while True:
            with self._lock:
                if not t.open:
                    raise RuntimeError("the transaction is closed")
                ended = list(self._ended)
                later = [(e.tid, e.row_ids) for e in ended[seen:] if e.cid > t.start]
                if not (wanted and later):
                    return self._append(t, sources)
            if _holders(reduce(DataFrame.union, wanted), later).first() is not None:
                self._close(t)
                raise WriteConflict("a row was deleted by another commit")
            seen = len(ended)

    def _append(self, t: Transaction, sources: list[tuple[DataFrame, int]]) -> int:
        cid, first = self.last_commit + 1, self.physical_rows()
        for rows, n in sources:
            self._deltas.append(_Delta(cid, t.tid, rows.withColumn(ROW, F.col(ROW) + F.lit(first)).select(*self.columns, ROW), n))
            first += n
        self._ended += [_Ended(cid, t.tid, d) for d in t.deletes]
        self.last_commit = cid
        self._close(t)
        return cid

    def insert(self, source: DataFrame) -> int:
        """Append all rows in order (bag semantics); returns the commit id."""
        return self.begin().insert(source).commit()

    def delete(self, row_ids: DataFrame) -> int:
        """End the rows with these ids."""
        t = self.begin()
        try:
            return t.delete(row_ids).commit()
        finally:
            self._close(t)

    def update(self, values: DataFrame, row_ids: DataFrame) -> int:
        """Replace whole rows: delete and insert in one commit."""
        t = self.begin()
        try:
            return t.delete(row_ids).insert(values).commit()
        finally:
            self._close(t)

    def physical_rows(self) -> int:
        """Rows ever written, deleted ones included."""
        return sum(d.count for d in self._deltas)

    def chunk_count(self) -> int:
        return -(-self.physical_rows() // self.chunk_rows)

    def versions(self) -> DataFrame:
        """All physical rows with ``_tid``, ``_begin_cid`` and ``_end_cid``; after ``compact`` those it kept."""
        parts = [d.rows if d.versioned else d.rows.select("*", F.lit(d.tid).cast("long").alias("_tid"), F.lit(d.cid).cast("long").alias("_begin_cid")) for d in self._deltas]
        rows = reduce(DataFrame.unionByName, parts)
        if not self._ended:
            return rows.withColumn("_end_cid", F.lit(NOT_ENDED).cast("long"))
        ends = reduce(DataFrame.union, [e.row_ids.select(ROW, F.lit(e.cid).cast("long").alias("_end_cid")) for e in self._ended])
        first = ends.groupBy(ROW).agg(F.min("_end_cid").alias("_end_cid"))
        return rows.join(first, ROW, "left").withColumn("_end_cid", F.coalesce("_end_cid", F.lit(NOT_ENDED).cast("long")))

    def snapshot(self, cid: int | None = None) -> DataFrame:
        """Rows visible at a commit (the last one by default), with ``row_index``."""
        at = self.last_commit if cid is None else cid
        if at < self.oldest:
            raise ValueError(f"versions before commit {self.oldest} were compacted")
        rows = reduce(DataFrame.unionByName, [d.rows.select(*self.columns, ROW) for d in self._deltas if d.cid <= at])
        gone = [e.row_ids.select(ROW) for e in self._ended if e.cid <= at]
        if gone:
            rows = rows.join(reduce(DataFrame.union, gone), ROW, "left_anti")
        return rows.select(*self.columns, ROW)

    def chunk_ranges(self, cid: int) -> DataFrame:
        """(chunk_id, begin_offset, end_offset) of the rows that a commit inserted."""
        parts = [d.rows.select(ROW) for d in self._deltas if d.cid == cid] or [self._deltas[0].rows.select(ROW).limit(0)]
        row = F.col(ROW)
        new = reduce(DataFrame.union, parts)
        return new.groupBy(chunk_id(row, self.chunk_rows).alias("chunk_id")).agg(F.min(chunk_offset(row, self.chunk_rows)).alias("begin_offset"), (F.max(chunk_offset(row, self.chunk_rows)) + 1).alias("end_offset"))

    def compact(self, path: str) -> None:
        """Write what is visible into a new folder under ``path``, so plans start from files again.

        Row ids and the commits that began the rows stay; snapshots before the last commit are given up and
        raise. Folders of earlier calls are left alone: readers may still use them. Open transactions must
        end first.
        """
        with self._lock:
            if self._open:
                raise RuntimeError("transactions are open")
            kept = self.versions().where(F.col("_end_cid") == NOT_ENDED).drop("_end_cid")
            kept.write.parquet(folder := f"{path}/commit-{self.last_commit:09d}-{uuid.uuid4().hex}")
            rows = self.spark.read.schema(kept.schema).parquet(folder)
            self._deltas = [_Delta(self.last_commit, INVALID_ID, rows, self.physical_rows(), versioned=True)]
            self._ended, self.oldest = [], self.last_commit


def lock_state(requests: DataFrame) -> DataFrame:
    """(row_index, locked) after one delete call over a position list.

    A position that the call meets again is unlocked again, so those listed an odd number of times stay
    locked.
    """
    return requests.groupBy(ROW).agg((F.count(F.lit(1)) % 2 == 1).alias("locked"))


def commit_max(commits: DataFrame, column: str) -> DataFrame:
    """The largest commit id that is none of the "not ended" marks; NULL if there is none."""
    return commits.agg(F.max(F.when(F.col(column) != NOT_ENDED, F.col(column))).alias("max_cid"))
