"""What the training-data operators share: scratch tables, table access and vectorised word hashing."""

from __future__ import annotations

import os
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Longest run of bytes hashed at once; a single longer text is taken whole.
CHUNK_BYTES = 1 << 20

# Rows and bytes in an Arrow batch where the session doesn't say otherwise, and what lets Python workers give
# much freed memory back rather than keep it for later tasks.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}
WORKERS = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(16 << 20), "MALLOC_TRIM_THRESHOLD_": str(48 << 20)}

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)

#: Byte values that end a word: the six ASCII blanks, or all ASCII but letters and digits.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[:128] = True
NOT_ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False


def session(df: DataFrame) -> SparkSession:
    return ready(df.sparkSession)


def ready(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by rows and bytes unless the session sets them itself, as whole texts make Spark's defaults too large
    for a small worker; has workers return freed memory; and lets them import this package from where the driver has
    it, which doesn't disturb a cluster that ships it another way."""
    set_by_user = spark._jsparkSession.sessionState().conf().settings()
    for key, value in BATCHES.items():
        if not set_by_user.containsKey(key):
            spark.conf.set(key, value)
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    for key, value in WORKERS.items():
        env.setdefault(key, value)
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH", ""), root) if x)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir. Where that is unset, in a single process a folder of our own;
    on a cluster an error, as no folder of one machine will do."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="marlstone-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


#: Rows of a few numbers that one task writes.
THIN_ROWS = 1 << 17


class Scratch:
    """Tables written to the shared folder; lineage ends at each, so a lost executor costs one stage."""

    def __init__(self, spark: SparkSession, owner: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{owner}-{uuid.uuid4().hex}"
        self.n, self.paths, self.held = 0, [], []

    def write(self, df: DataFrame, name: str, rows: int | None = None, costly: bool = False, large: bool = False) -> DataFrame:
        """rows: of a table of thin rows, how many there are at most; it is then written by one task per THIN_ROWS of them, as each
        file that is written costs processes and requests, which for very many partitions is more than its rows. costly: making
        the rows is work that should stay spread, so they are exchanged once more. large: what was exchanged for it is much of the
        input; Spark deletes that when the driver collects garbage, which is asked for here."""
        self.n += 1
        path = f"{self.root}/{self.n}-{name}"
        if rows is not None and (tasks := max(1, -(-rows // THIN_ROWS))) < shuffle_width(self.spark):
            df = df.repartition(tasks) if costly else df.coalesce(tasks)
        df.write.option("compression", "zstd").parquet(path)
        if large:
            self.spark._jvm.System.gc()
            time.sleep(0.3)
            self.spark._jvm.System.gc()
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.append(path)
        return out

    def hold(self, df: DataFrame) -> DataFrame:
        """df, kept on the executors' disks from its first use until release. Its lineage stays, so that what a lost executor held
        is made again; for tables a few steps from the input."""
        self.held.append(df.persist(StorageLevel.DISK_ONLY))
        return self.held[-1]

    def release(self) -> None:
        """Lets go of what is held, once nothing lazy depends on it."""
        for df in self.held:
            df.unpersist()
        self.held.clear()

    def keep_only(self, *tables: DataFrame) -> None:
        """Deletes the other tables, once nothing lazy depends on them."""
        kept = {t._scratch_path for t in tables}
        for path in [p for p in self.paths if p not in kept]:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
            self.paths.remove(path)


def without(df: DataFrame, *names: str) -> DataFrame:
    """Drops columns of the input whose names an operator's own columns take (case-insensitively)."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def free_name(df: DataFrame, wish: str = "_made") -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while wish in taken:
        wish += "_"
    return wish


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, element by element."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the multiplier and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for k, m in enumerate((_MULTIPLIER, _INVERSE)):
            a = np.full(max(n, CHUNK_BYTES + 1), m)
            a[0] = 1
            _powers[k] = np.multiply.accumulate(a)
    return _powers[0][:n], _powers[1][:n]


def prefix_hash(data: np.ndarray, values: np.ndarray = _BYTE_VALUES) -> np.ndarray:
    """S with S[i] = sum of value(byte j) * M^j over j < i; a span's hash is (S[e]-S[s]) * M^-s."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * powers(len(data))[0], out=out[1:])
    return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_LOWER_VALUES = _BYTE_VALUES[_LOWER]


class Words:
    """Word hashes of consecutive texts: words of text first+k are hashes[bounds[k]:bounds[k+1]]."""

    __slots__ = ("first", "bounds", "hashes")

    def __init__(self, first: int, bounds: np.ndarray, hashes: np.ndarray):
        self.first, self.bounds, self.hashes = first, bounds, hashes

    def __len__(self) -> int:
        return len(self.bounds) - 1


def hash_words(texts: list[str | None], separators: np.ndarray, chunk: int = CHUNK_BYTES) -> Iterator[Words]:
    """64-bit hashes of the words of each text, A-Z lower-cased; texts go through in runs of about chunk bytes."""
    i = 0
    while i < len(texts):
        parts, size, first = [], 0, i
        while i < len(texts) and (not parts or size < chunk):
            parts.append((texts[i] or "").encode("utf-8", "surrogatepass"))
            size += len(parts[-1]) + 1
            i += 1
        data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
        inside = ~separators[data]
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        starts, ends = edge[0::2], edge[1::2]
        s = prefix_hash(data, _LOWER_VALUES)
        hashes = mix((s[ends] - s[starts]) * powers(len(data))[1][starts] + (ends - starts).astype(np.uint64))
        at = np.cumsum([0, *(len(p) + 1 for p in parts)])
        yield Words(first, np.searchsorted(starts, at), hashes)


def combine(*columns: np.ndarray) -> np.ndarray:
    """One hash for each row of hash columns, order counting."""
    out = np.full(len(columns[0]), 0x243F6A8885A308D3, np.uint64)
    for c in columns:
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + c)
    return out
