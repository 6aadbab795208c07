"""What the operators share: tables, shared-folder checkpoints, and word hashing over Arrow text columns."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.plans.ship import ship

#: The white space of every contract: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of text that one numpy step works on; a longer document is one step of its own.
STEP_BYTES = 1 << 20

_FALLBACK: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Only where the setting is absent on one machine (tests) is it a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="folioscope-"))
    return _FALLBACK[0]


_SCRATCH: list[list[str]] = []
_NAMES: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are saved within are deleted at the end, by when what was made of them must be written."""
    _SCRATCH.append([])
    _NAMES.append([])
    try:
        yield
    finally:
        for name in _NAMES.pop():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        for path in _SCRATCH.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, name: str, beyond: bool = False) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and every executor can read it. In scratch() the
    table is deleted at that one's end, or at the end of the one around it if it is wanted beyond."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _SCRATCH[: -1 if beyond else None][-1:]:
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, buckets: int, key: str, beyond: bool = False, deal: bool = True) -> DataFrame:
    """df as a table in the shared folder, bucketed and sorted by key, so that joins by it of tables of as many buckets don't shuffle.
    In scratch() it is deleted at that one's end, or at the end of the one around it if it is wanted beyond. deal=False: df is dealt by key already."""
    known = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(df.sparkSession)}/{known}"
    (df.repartition(buckets, key) if deal else df).write.bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(known)
    for paths, names in list(zip(_SCRATCH, _NAMES, strict=True))[: -1 if beyond else None][-1:]:
        paths.append(path)
        names.append(known)
    return df.sparkSession.table(known)


#: Groups of this share of the rows and more are broadcast, which are LARGE_SHARE at most.
LARGE_SHARE = 10_000


def joined_to_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int) -> DataFrame:
    """rows joined to groups of them by key (size: a group's rows, total: all rows) without that a large group meets in one task:
    there are LARGE_SHARE large groups at most, which are broadcast; others are joined by a shuffle."""
    large = F.broadcast(groups.where(F.col(size) * LARGE_SHARE >= total))
    others = rows.join(large.select(*key), key, "left_anti")
    return rows.join(large, key).unionByName(others.join(groups.where(F.col(size) * LARGE_SHARE < total), key))


def fitted(df: DataFrame, rows: int, each: int) -> DataFrame:
    """df in no more partitions than its number of rows asks for, but one for each core: small tables in few files."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def mapped(df: DataFrame, f, schema: str) -> DataFrame:
    """df.mapInArrow, with this package on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(f, schema)


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that further columns of the input can't clash with those an operator makes."""
    return df.select(*names)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and its n + 1 offsets into them; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), at


def steps(offsets: np.ndarray, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents that hold about size bytes each, one document at least."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACES]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_POWERS: list[np.ndarray] = []


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        made = []
        for base in (_BASE, _UNBASE):
            x = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        if n > 8 * STEP_BYTES:
            return made[0], made[1]
        _POWERS[:] = made
    return _POWERS[0], _POWERS[1]


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts: starts, ends (bytes from the first text's start), 64-bit hashes of the
    words, A-Z in lower case if asked, and the n + 1 positions in these arrays at which each text's words begin."""
    first, last = int(offsets[0]), int(offsets[-1])
    raw, cuts = data[first:last], offsets - first
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), np.zeros(len(offsets), np.int64)
    solid = ~_SPACE[raw]
    before, after = np.empty(n, bool), np.empty(n, bool)
    before[0], before[1:] = False, solid[:-1]
    after[-1], after[:-1] = False, solid[1:]
    inner = cuts[(cuts > 0) & (cuts < n)]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum((_BYTE_LOWER if lower else _BYTE)[raw] * up[:n], out=sums[1:])
        hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _BASE)
    return starts, ends, hashes, np.searchsorted(starts, cuts)


def hash_of(text: str) -> int:
    """The hash that words() gives one word."""
    data = np.frombuffer(text.encode(), np.uint8)
    return int(words(data, np.array([0, len(data)]))[2][0])


def fold_of(column: str, folds: int) -> F.Column:
    """crc32 of an id as text, modulo folds."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))
