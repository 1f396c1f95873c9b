"""Sum-of-squares packing of token sequences into windows of one length.

Documents arrive one by one.  What fills whole windows is cut off first; the rest of
a document goes into the partially filled window whose level makes the sum of squared
counts of windows by level least afterwards (a new window counts as level 0; of equal
choices the fullest window is taken).  The counts are kept in an array by level.  This
keeps windows of every level in stock, so that most rests find their exact complement.

*Bounded memory.*  A level holds at most ``LEVEL_MOST`` windows.  A rest that would make
one more of them is cut: its beginning completes a window of that level, and what is
left is placed by the rule again.  So lengths that never add up to a window, such as
one length only, cost a cut now and then, no memory and no padding.

*Over tasks.*  Each task packs the rows that it reads.  Windows still open at its end are
few (by level, not by rows) and are neither padded nor emptied there: their rests go to
a task that packs those of ``FAN`` tasks by the same rule, and so on until one task is left.
Only that one finishes: its fullest windows, as the rule has filled them, are
completed from the emptiest ones, which cuts at most one rest a window.  What is
shorter than a window then, less than one for the whole corpus, becomes sequences
whose lengths are powers of two and so need no padding.

Defined results: a null or empty text is its closing token; repeated rows are packed
each, whatever their key, null keys too; an empty table makes no piece; a text of any
length is cut into as many windows as it needs; other columns, whatever their names,
aren't read.  Sequence numbers are unique over all tasks and depend on the input files
and their split alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import arrow_schema, portions, small_batches, staged, tidied, whole_groups

WINDOW, CLOSING = 1024, 0
#: Windows of one level that a task holds open at most, and tasks whose open windows one task takes on.
LEVEL_MOST, FAN = 32, 64

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: A piece as it lies between the steps: ``sequence_id`` is null while its window is open.
_STEP = PIECES + ", task long, place long"


class Packer:
    """Packs one stream.  ``out`` takes (key, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int = WINDOW, level_most: int = LEVEL_MOST):
        self.window, self.most, self.next = window, level_most, 0
        self.counts = [0] * (window + 1)  # windows by level
        self.stock: list[list[list]] = [[] for _ in range(window)]  # open windows by level: lists of pieces
        # what the sum of squares gains by one window more, and loses by one less, at each level
        self.more, self.less = np.ones(window + 1, np.int64), np.full(window, -(1 << 60), np.int64)
        self.more[window] = self.less[0] = 0  # full windows leave the stock, new ones come from nowhere
        self.out: list[tuple] = []

    def add(self, key, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for at in range(0, whole, self.window):
            self._emit([(key, at, ids[at : at + self.window], total)])
        if whole < total:
            self.place((key, whole, ids[whole:].copy(), total))

    def choose(self, size: int) -> int:
        """The level whose window a rest of this size goes into; 0 is a new one."""
        change = self.more[size:] - self.less[: self.window - size + 1]
        return self.window - size - int(np.argmin(change[::-1]))

    def place(self, piece: tuple) -> None:
        key, start, ids, total = piece
        while True:
            level = self.choose(len(ids))
            target = level + len(ids)
            room = self.window - target
            if not (0 < room < len(ids) and self.counts[target] >= self.most):
                break
            self._emit([*self._take(target), (key, start, ids[:room], total)])
            start, ids = start + room, ids[room:]
        pieces = [*(self._take(level) if level else ()), (key, start, ids, total)]
        if room == 0:
            self._emit(pieces)
        else:
            self.stock[target].append(pieces)
            self._count(target, 1)

    def _take(self, level: int) -> list[tuple]:
        self._count(level, -1)
        return self.stock[level].pop()

    def _count(self, level: int, by: int) -> None:
        self.counts[level] = n = self.counts[level] + by
        self.more[level], self.less[level] = 2 * n + 1, 2 * n - 1 if n else -(1 << 60)

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for key, start, ids, total in pieces:
            self.out.append((key, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def drain(self) -> list[tuple]:
        """The rests of all open windows, fullest first; none stays."""
        rests = [p for level in range(self.window - 1, 0, -1) for window in self.stock[level] for p in window]
        self._empty()
        return rests

    def _empty(self) -> None:
        for level in range(1, self.window):
            if self.counts[level]:
                self.stock[level] = []
                self._count(level, -self.counts[level])

    def finish(self) -> None:
        """Complete the fullest open windows with what the emptiest hold."""
        windows = [w for level in range(self.window - 1, 0, -1) for w in self.stock[level]]
        self._empty()
        giving: list[tuple] = []
        at, end = 0, len(windows)
        while at < end:
            room = self.window - sum(len(p[2]) for p in windows[at])
            while room and (giving or at < end - 1):
                if not giving:
                    end -= 1
                    giving = windows[end]
                key, start, ids, total = giving.pop(0)
                windows[at].append((key, start, ids[:room], total))
                if len(ids) > room:
                    giving.insert(0, (key, start + room, ids[room:], total))
                room -= min(room, len(ids))
            if room:
                giving = windows[at]
                break
            self._emit(windows[at])
            at += 1
        left = sum(len(p[2]) for p in giving)
        while left:  # shorter than a window
            room, now = 1 << left.bit_length() - 1, []
            left -= room
            while room:
                key, start, ids, total = giving.pop(0)
                now.append((key, start, ids[:room], total))
                if len(ids) > room:
                    giving.insert(0, (key, start + room, ids[room:], total))
                room -= min(room, len(ids))
            self._emit(now)


def _batch(schema: pa.Schema, done: list[tuple], first: int, task: int, open_: list[tuple] = ()) -> pa.RecordBatch:
    """Rows of finished pieces, numbered from ``first``, and of open ones."""
    rows = [(k, s, len(i), i.tobytes(), t, first + n, o, task, 0) for k, s, i, t, n, o in done]
    rows += [(k, s, len(i), i.tobytes(), t, None, None, task, place) for place, (k, s, i, t) in enumerate(open_)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _number(step: int, task: int) -> int:
    """The first of the sequence numbers that a task of a step has to itself."""
    return step << 58 | task << 34


def pack(df: DataFrame, path: str, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text", fan: int = FAN) -> DataFrame:
    """One row a piece: its document, place and ids (little-endian, 32 bits), and the sequence and place it lies in."""
    schema = arrow_schema(_STEP)

    def read(batches):
        from pyspark import TaskContext

        from ledgerloom.llm.tokens import codec

        bpe, packer, task = codec(path), Packer(window), TaskContext.get().partitionId()
        for batch in batches:
            for part in portions(batch, 1, 64):
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    packer.add(key, np.array(bpe.encode(text) + [CLOSING], "<u4"))
                if packer.out:
                    yield _batch(schema, packer.out, _number(0, task), task)
                    packer.out = []
        if rests := packer.drain():
            yield _batch(schema, [], 0, task, rests)

    step = staged(small_batches(df).select(F.col(f"`{id_column}`").cast("long"), f"`{text_column}`").mapInArrow(tidied(read), _STEP), "pieces")
    done, level = [step.where("sequence_id IS NOT NULL")], 0
    while (last := step.where("sequence_id IS NULL").agg(F.max("task")).first()[0]) is not None:
        level += 1
        step = staged(_merge(step, fan, level, last < fan, window), "open-pieces")
        done.append(step.where("sequence_id IS NOT NULL"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("task", "place")


def _merge(step: DataFrame, fan: int, level: int, last: bool, window: int) -> DataFrame:
    """Pack the open pieces of each ``fan`` tasks; the last merge finishes."""
    schema = arrow_schema(_STEP)

    def run(batches):
        for group, task, place, key, start, ids, total in whole_groups(batches, 7):
            for g in np.unique(group).tolist():
                packer = Packer(window)
                for i in np.flatnonzero(group == g).tolist():
                    packer.place((None if key[i] is None else int(key[i]), int(start[i]), np.frombuffer(ids[i], "<u4"), int(total[i])))
                if last:
                    packer.finish()
                    rests = []
                else:
                    rests = packer.drain()
                yield _batch(schema, packer.out, _number(level, g), g, rests)

    rests = step.where("sequence_id IS NULL").select(F.floor(F.col("task") / fan).alias("group"), "task", "place", "doc_id", "start", "ids", "doc_tokens")
    return rests.repartition("group").sortWithinPartitions("group", "task", "place").mapInArrow(tidied(run), _STEP)
