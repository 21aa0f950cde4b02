"""Shared by the training-data operators: tables, lineage cuts, and word hashing over Arrow buffers."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space, as the contracts define words: [^\x20\x09-\x0D]+
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
#: Bytes of text worked on at once in a Python worker; only bounds memory, never what is read.
PIECE = 1 << 20

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BYTE[list(SPACES)] = 0
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[list(SPACES)] = True
_P = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where none is set, in local mode."""
    sc = spark.sparkContext
    if (own := sc._jsc.sc().getCheckpointDir()).isDefined():
        return own.get()
    if set_ := spark.conf.get("spark.checkpoint.dir", None):
        sc.setCheckpointDir(set_)
    elif not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    else:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="emberline-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from there, so a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same as a Parquet table of its own in the shared folder: smaller, and read by column."""
    folder = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def swept(df: DataFrame) -> None:
    """Have Spark remove shuffle files that no frame needs: it does so when the driver's collector runs, which else is by chance."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _words_of(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the words of data; a word also ends at each break."""
    inside = ~_SPACE[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    breaks = breaks[breaks < len(data)]
    start[breaks] = inside[breaks]
    starts = np.flatnonzero(start)
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    lengths = np.diff(starts, append=len(data))
    place = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    powers = np.full(int(lengths.max()), _P, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    # white space after a word adds nothing
    return starts, mix(np.add.reduceat(_BYTE[data[starts[0] :]] * powers[place], starts - starts[0]))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z only) words of each document, and where each document's begin.

    Works on a few MB at once, cut at white space or between documents.
    """
    at, found, hashes = 0, [], []
    while at < len(data):
        end = min(at + PIECE, len(data))
        while end < len(data) and not _SPACE[data[end - 1]]:
            # on to the next white space or document
            step = np.flatnonzero(_SPACE[data[end : end + PIECE]])
            following = offsets[np.searchsorted(offsets, end)]
            end = int(min(following, end + (step[0] + 1 if len(step) else PIECE), len(data)))
            if end == following:
                break
        inner = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end)] - at
        s, h = _words_of(data[at:end], inner)
        found.append(s + at)
        hashes.append(h)
        at = end
    if not found:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(found), offsets)


def slices(batch: pa.RecordBatch, text: str, most: int = 2 * PIECE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text each; a single longer text is a part of its own."""
    sizes = np.cumsum(np.diff(text_buffer(batch.column(text))[1]))
    at = 0
    while at < batch.num_rows:
        before = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, before + most)))
        yield batch.slice(at, end - at)
        at = end
