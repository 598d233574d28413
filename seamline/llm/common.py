"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

PIECE_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one in local mode (tests); on a
    cluster that is an error, as executors could not read it."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return at or tempfile.mkdtemp(prefix="ckpt-")


def pin(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder, read again."""
    at = f"{shared_folder(df.sparkSession).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def pieces(batches, most: int = PIECE_BYTES):
    """The batches cut into slices of equal rows and about ``most`` bytes, so that what is made of them stays small."""
    for b in batches:
        step = max(1, b.num_rows * most // max(most, b.nbytes))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def release() -> None:
    """Give memory that a task no longer needs back to the system, as workers are used again by other tasks."""
    import ctypes
    import gc

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_rows(
    df: DataFrame,
    args: dict[str, Column | str],
    out: dict[str, T.DataType],
    start: Callable[[], Callable[..., dict]],
    keep: list[str] | None = None,
    piece_bytes: int = PIECE_BYTES,
    as_bytes: bool = False,
) -> DataFrame:
    """Add the columns of ``out`` to every row, computed in pieces of Arrow batches of about ``piece_bytes``.

    ``start()`` runs once a task and returns ``f(**lists)``, which gets one list for each of ``args`` and returns one
    list for each of ``out``. Kept columns pass through as Arrow data under private names, so no name can clash; a
    kept column named like one of ``out`` is replaced by it. An argument given by a column's name is not sent twice if
    it is kept; ``as_bytes`` reads such texts as their UTF-8 bytes.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in out]
    place = {k: keep.index(v) for k, v in args.items() if isinstance(v, str) and v in keep}
    sent = {k: df[f"`{v}`"] if isinstance(v, str) else v for k, v in args.items() if k not in place}
    place |= {k: len(keep) + i for i, k in enumerate(sent)}
    inner = df.select(
        *[df[f"`{c}`"].alias(f"k{i}") for i, c in enumerate(keep)], *[v.alias(f"a_{k}") for k, v in sent.items()]
    )
    held = list(inner.schema.fields[: len(keep)])
    schema = T.StructType(held + [T.StructField(f"o_{k}", v) for k, v in out.items()])
    kinds = {k: to_arrow_type(v) for k, v in out.items()}
    names, n_keep = schema.names, len(keep)

    def listed(b, i):
        c = b.column(i)
        return (c.cast(pa.binary()) if as_bytes and pa.types.is_string(c.type) else c).to_pylist()

    def run(batches):
        f = start()
        for b in pieces(batches, piece_bytes):
            got = f(**{k: listed(b, i) for k, i in place.items()})
            new = [pa.array(got.pop(k), type=kind) for k, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_keep], *new], names=names)
        del f
        release()

    done = inner.mapInArrow(run, schema)
    return done.select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *[F.col(f"o_{k}").alias(k) for k in out]
    )


def one_thread() -> None:
    """Make numpy's OpenBLAS use one thread in this process: a task has one core, and more threads only wait there."""
    import ctypes
    import os
    import re

    if os.path.exists("/proc/self/maps"):
        with open("/proc/self/maps") as f:
            names = set(re.findall(r"/\S*openblas\S*\.so\S*", f.read()))
        for name in names:
            lib = ctypes.CDLL(name)
            for form in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, form):
                    getattr(lib, form)(ctypes.c_int(1))
                    break


def chunks(sizes: list[int], most: int):
    """Ranges [i, j) of rows that hold about ``most`` in all."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
