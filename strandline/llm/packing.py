"""Pack token ids of documents into sequences of a fixed length: bounded-space online packing.

Every task keeps `windows` open sequences. A document's full lengths become sequences of their own; its rest
goes to the fullest window in which it fits, else to a new window while fewer are open, else the fullest
window is emitted, topped up by a cut of the rest. At its end a task runs its open windows together, so one
partly filled window per task is left over. Leftovers carry their ids and are merged by the same function in
groups of `MERGE` tasks, again and again until one group is left; that one closes the last window. So the padding of
a whole corpus is that of one sequence, no task holds more than its windows, and nothing but window rests is
shuffled.

The first pass is written to the shared folder, so a lost executor repeats its own tasks only. A sequence id
is (level, task, running number) and does not depend on timing.

Defined cases: null and empty texts give the end id alone; repeated rows are packed as often as they come; an
empty table gives an empty result; extra columns are ignored; very long texts are cut into many sequences.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stage import stage
from .chunks import Chunks
from .words import slices

LENGTH, WINDOWS, END, MERGE = 1024, 64, 0, 256
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


class Packer:
    """Open windows of one task. A window is a list of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, base: int, length: int = LENGTH, windows: int = WINDOWS):
        self.base, self.length, self.windows = base, length, windows
        self.open: list[list] = []
        self.fill: list[int] = []
        self.count = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list, final: bool = True) -> None:
        sequence, offset = self.base + self.count, 0
        self.count += 1
        for doc, start, ids, total in pieces:
            raw = ids.tobytes()
            self.rows.append((doc, start, len(ids), zlib.crc32(raw), total, sequence, offset, None if final else raw))
            offset += len(ids)

    def add(self, doc: int, ids: np.ndarray, start: int = 0, total: int | None = None) -> None:
        total = len(ids) if total is None else total
        at, n = 0, self.length
        while len(ids) - at >= n:
            self.emit([(doc, start + at, ids[at:at + n], total)])
            at += n
        while (left := len(ids) - at) > 0:
            best = max((i for i, f in enumerate(self.fill) if f + left <= n), key=self.fill.__getitem__, default=None)
            if best is None and len(self.open) < self.windows:
                self.open.append([])
                self.fill.append(0)
                best = len(self.open) - 1
            if best is None:
                best = max(range(len(self.fill)), key=self.fill.__getitem__)
                left = n - self.fill[best]
            self.open[best].append((doc, start + at, ids[at:at + left], total))
            self.fill[best] += left
            at += left
            if self.fill[best] == n:
                self.emit(self.open.pop(best))
                self.fill.pop(best)

    def close(self, final: bool) -> None:
        """Run the open windows together; the last one is emitted or left over."""
        order = sorted(range(len(self.open)), key=lambda i: -self.fill[i])
        rest = [p for i in order for p in self.open[i]]
        self.open, self.fill, self.windows = [], [], 1
        for doc, start, ids, total in rest:
            self.add(doc, ids, start, total)
        if self.open:
            self.emit(self.open.pop(), final)
            self.fill.pop()

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * 8
        self.rows = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(cols[7], pa.binary())], [*names, "ids"])


def pack(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, windows: int = WINDOWS,
         tokenizer: str | None = None, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first(batches):
        chunks, packer = None, Packer(TaskContext.get().partitionId() << 32, length, windows)
        for batch in slices(batches):
            chunks = chunks or Chunks(tokenizer)
            ids, starts = chunks.encode(batch.column("text"))
            last = np.array([end], np.uint32)
            for k, doc in enumerate(batch.column("doc_id").to_pylist()):
                packer.add(doc, np.concatenate([ids[starts[k]:starts[k + 1]], last]))
            yield packer.take()
        packer.close(False)
        yield packer.take()

    def merge(level: int, final: bool):
        def group(key, table):
            packer = Packer((level << 56) | (key[0].as_py() << 32), length, windows)
            table = table.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
            for doc, start, total, raw in zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))):
                packer.add(doc, np.frombuffer(raw, np.uint32), start, total)
            packer.close(final)
            return pa.Table.from_batches([packer.take()])
        return group

    rows = stage(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(first, SCHEMA))
    names = rows.columns[:-1]
    done, left, level = [rows.where("ids is null").select(names)], rows.where("ids is not null"), 1
    tasks = (rows.agg(F.max(F.shiftright("sequence_id", 32))).first()[0] or 0) + 1
    while True:
        groups = -(-tasks // MERGE)
        task = F.shiftright("sequence_id", 32).bitwiseAND(F.lit((1 << 24) - 1))
        merged = left.groupBy(F.floor(task / MERGE).cast("long").alias("group")).applyInArrow(merge(level, groups == 1), SCHEMA)
        if groups == 1:
            done.append(merged.select(names))
            break
        merged = stage(merged)
        done.append(merged.where("ids is null").select(names))
        left, tasks, level = merged.where("ids is not null"), groups, level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
