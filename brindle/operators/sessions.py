"""Sessions by inactivity gaps, from occupancy bitmaps.

Each entity's time line is cut into blocks of one day; a block's occupied seconds are the bits of a bitmap. A
morphological closing as wide as the gap (dilation, then erosion, each by doubling shifts) fills the holes that do not
end a session, and the runs of set bits are the block's sessions. Counts and first and last rows are joined to the
runs from the per-second totals. Runs of neighbouring blocks are put together by one window over the runs; an entity
has at most one run per gap and block, however many rows it holds. Times finer than a second are exact: each second
keeps its first and last row, and only where two occupied seconds lie exactly a gap apart are those looked at.

Rows are reduced to their seconds in each batch before the one shuffle by entity and day, and again behind it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of one block, and so bits of one bitmap.
BLOCK = 86_400
#: Bitmaps that are closed at once: 512 times 86,400 bits are 5.5 MB a copy.
AT_ONCE = 512

CELL = ["entity", "block", "second", "first_us", "first_id", "last_us", "last_id", "rows"]
CELLS = pa.schema([("entity", pa.string()), *[(c, pa.int64()) for c in CELL[1:]]])
RUNS = "entity string, first_us bigint, first_id bigint, last_us bigint, last_id bigint, rows bigint"


def _shift(words: np.ndarray, by: int) -> np.ndarray:
    """Bits of each row moved ``by`` places up (down if negative); zeros come in."""
    out = np.zeros_like(words)
    step, bits = divmod(abs(by), 64)
    width = words.shape[1]
    if step >= width:
        return out
    if by >= 0:
        out[:, step:] = words[:, : width - step] << np.uint64(bits) if bits else words[:, : width - step]
        if bits:
            out[:, step + 1 :] |= words[:, : width - step - 1] >> np.uint64(64 - bits)
    else:
        out[:, : width - step] = words[:, step:] >> np.uint64(bits) if bits else words[:, step:]
        if bits:
            out[:, : width - step - 1] |= words[:, step + 1 :] << np.uint64(64 - bits)
    return out


def close_gaps(words: np.ndarray, gap: int) -> np.ndarray:
    """Morphological closing of each row of packed bits: holes of fewer than ``gap`` places between set bits are set.

    The rows need ``gap`` free places at their upper end.
    """
    have = 1
    wide = words.copy()
    while have < gap:  # dilate: bit i covers i .. i + gap - 1
        step = min(have, gap - have)
        wide |= _shift(wide, step)
        have += step
    have, shut = 1, wide
    while have < gap:  # erode from above: keep i where i .. i + gap - 1 are covered
        step = min(have, gap - have)
        shut = shut & _shift(shut, -step)
        have += step
    # Eroding by look-ahead puts each run back to its own start; its end is start of cover plus length minus gap + 1.
    return shut


def _runs(keys: np.ndarray, second: np.ndarray, first_us: np.ndarray, last_us: np.ndarray, gap: int) -> np.ndarray:
    """Index of the first cell of each run; cells are sorted by key and second, and no two have both alike."""
    starts = np.ones(len(keys), dtype=bool)
    fresh = np.r_[True, keys[1:] != keys[:-1]]
    heads = np.flatnonzero(fresh)
    row = np.cumsum(fresh) - 1
    words = (BLOCK + gap + 63) // 64 + 1
    for low in range(0, len(heads), AT_ONCE):
        a = heads[low]
        b = heads[low + AT_ONCE] if low + AT_ONCE < len(heads) else len(keys)
        own = row[a:b] - low
        bits = np.zeros((own[-1] + 1, words), dtype=np.uint64)
        np.bitwise_or.at(bits, (own, second[a:b] >> 6), np.uint64(1) << (second[a:b] & 63).astype(np.uint64))
        shut = close_gaps(bits, gap)
        begins = shut & ~_shift(shut, 1)
        starts[a:b] = (begins[own, second[a:b] >> 6] >> (second[a:b] & 63).astype(np.uint64)) & np.uint64(1) == 1
    # The bitmaps leave open what is apart by the gap in whole seconds; the rows of both seconds tell.
    tight = np.flatnonzero(~fresh & (np.r_[0, np.diff(second)] == gap))
    starts[tight] = first_us[tight] - last_us[tight - 1] > gap * 1_000_000
    return np.flatnonzero(starts)


#: Stands for a null id while rows are compared, as nulls sort first.
NO_ID = np.iinfo(np.int64).min


def _numbers(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False).astype(np.int64) for c in names]


def _seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's rows (entity, us, id) as cells: one for each entity and second, with its first and last row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        entity = batch.column("entity").dictionary_encode()
        code = entity.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        us, ids = _numbers(batch, "us", "id")
        order = np.lexsort((ids, us, code))
        code, us, ids = code[order], us[order], ids[order]
        at = us // 1_000_000
        begin = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])])
        end = np.r_[begin[1:], len(us)] - 1
        yield pa.RecordBatch.from_arrays(
            [entity.dictionary.take(pa.array(code[begin])), *map(pa.array, (at[begin] // BLOCK, at[begin] % BLOCK, us[begin], ids[begin], us[end], ids[end], end - begin + 1))], names=CELL
        )


def _merged(key: np.ndarray, cells: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cells (second, first_us, first_id, last_us, last_id, rows), those of the same key and second made one, and where each begins.

    They are sorted by key, second, first_us and first_id.
    """
    second, first_us, first_id, last_us, last_id, rows = cells
    fresh = np.r_[True, (key[1:] != key[:-1]) | (second[1:] != second[:-1])]
    begin = np.flatnonzero(fresh)
    if len(begin) == len(key):
        return begin, cells
    last = np.lexsort((last_id, last_us, np.cumsum(fresh)))[np.r_[begin[1:], len(key)] - 1]
    return begin, [second[begin], first_us[begin], first_id[begin], last_us[last], last_id[last], np.add.reduceat(rows, begin)]


def _block_runs(gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last second, which may go on in the next batch

        def found(batch: pa.RecordBatch, whole: bool) -> tuple[pa.RecordBatch, pa.RecordBatch | None]:
            codes = batch.column("entity").dictionary_encode()
            code = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            block, *cells = _numbers(batch, *CELL[1:])
            key = code << 32 | block & 0xFFFFFFFF
            at, cells = _merged(key, cells)
            keep = None
            if not whole:
                cut = {c: [int(v[-1])] for c, v in zip(CELL[2:], cells, strict=True)}
                keep = pa.RecordBatch.from_pydict({"entity": [codes.dictionary[int(code[at[-1]])].as_py()], "block": [int(block[at[-1]])], **cut}, schema=CELLS)
                at, cells = at[:-1], [c[:-1] for c in cells]
            second, first_us, first_id, last_us, last_id, rows = cells
            begin = _runs(key[at], second, first_us, last_us, gap) if len(at) else np.empty(0, dtype=np.int64)
            end = np.r_[begin[1:], len(at)] - 1 if len(begin) else begin
            total = np.add.reduceat(rows, begin) if len(begin) else rows[:0]
            ids = lambda x: pa.array(x, mask=x == NO_ID)
            entity = codes.dictionary.take(pa.array(code[at[begin]]))
            out = [entity, pa.array(first_us[begin]), ids(first_id[begin]), pa.array(last_us[end]), ids(last_id[end]), pa.array(total)]
            return pa.RecordBatch.from_arrays(out, names=["entity", "first_us", "first_id", "last_us", "last_id", "rows"]), keep

        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.select(CELL).cast(CELLS)
            joined = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            runs, held = found(joined, False)
            yield runs
        if held is not None:
            yield found(held, True)[0]

    return run


def sessionize(df: DataFrame, entity: Column, time: Column, row_id: Column, gap_seconds: int = 1800) -> DataFrame:
    """One row per session: entity, session_no, first_id, last_id, start, end, duration_s, rows.

    A session ends where the next row comes more than ``gap_seconds`` later; exactly that much does not end it. Rows
    stand in order of time, then id; equal times and repeated rows stay in one session and are counted. Rows whose
    entity or time is null are left out; a null id sorts before the others and may come out as first_id. An empty
    table gives an empty result; other columns of ``df`` are ignored.
    """
    if gap_seconds < 1:
        raise ValueError("gap_seconds has to be 1 or more")
    events = df.select(entity.cast("string").alias("entity"), F.unix_micros(time.cast("timestamp")).alias("us"), row_id.cast("bigint").alias("id")).where("entity is not null and us is not null")
    cells = events.mapInArrow(_seconds, ", ".join(f"{c} {'string' if c == 'entity' else 'bigint'}" for c in CELL))
    # Each block lies in one task, sorted, however its rows came; a key's blocks are spread over the tasks.
    runs = cells.repartition("entity", "block").sortWithinPartitions("entity", "block", "second", "first_us", "first_id").mapInArrow(_block_runs(gap_seconds), RUNS)
    line = Window.partitionBy("entity").orderBy("first_us", "first_id")
    opened = F.when(F.col("first_us") - F.lag("last_us").over(line) <= gap_seconds * 1_000_000, 0).otherwise(1)
    joined = runs.withColumn("opens", opened).withColumn("session_no", F.sum("opens").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = joined.groupBy("entity", "session_no").agg(
        F.min(F.struct("first_us", "first_id")).alias("a"), F.max(F.struct("last_us", "last_id")).alias("b"), F.sum("rows").alias("rows")
    )
    return out.select(
        "entity", "session_no", F.col("a.first_id").alias("first_id"), F.col("b.last_id").alias("last_id"),
        F.timestamp_micros("a.first_us").alias("start"), F.timestamp_micros("b.last_us").alias("end"),
        ((F.col("b.last_us") - F.col("a.first_us")) / 1e6).alias("duration_s"), "rows",
    )
