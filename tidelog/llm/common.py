"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables that grow with the data are broadcast up to this; operators have another way beyond it.
BROADCAST_BYTES = 64 << 20
#: Bytes of a token and its figures in a worker's dictionary, about.
TOKEN_BYTES = 200

#: Bytes of a text to bytes of its words: A-Z to lower case, 0-9, a-z and all bytes
#: of non-ASCII characters kept, anything else a space.
WORD_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)


def words_of(data: bytes | None) -> list[bytes]:
    """Lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of UTF-8 bytes; none for None."""
    return (data or b"").translate(WORD_TABLE).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local one only where that is unset, as in tests."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not path:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isDefined():
            return have.get()
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tidelog-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def stash(df: DataFrame, tag: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """A string column as UTF-8 bytes."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns of these names, in any case: results win over input columns."""
    low = {n.lower() for n in names}
    return df.select(*[f"`{c}`" for c in df.columns if c.lower() not in low])


def attach(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    replace_text: bool = False,
) -> DataFrame:
    """Add columns computed from Arrow batches; ``make()`` runs once in each task.

    Input columns with the name of a new one give way to it. With ``replace_text``
    the input column ``text`` does too.
    """
    drop = [f.name for f in fields if replace_text or f.name.lower() != text.lower()]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in drop}]
    if not replace_text and text not in kept:
        raise ValueError(f"a result may not be called {text}")
    schema = T.StructType([df.schema[c] for c in kept] + fields)
    kinds = [pa.field(f.name, _arrow(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [pa.array(v, type=k.type) if not isinstance(v, pa.Array) else v for v, k in zip(fn(batch), kinds, strict=True)]
            old = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays(old + new, names=[*kept, *[k.name for k in kinds]])

    return df.mapInArrow(run, schema)


def joined_sums(docs: DataFrame, table: DataFrame, tokens_of: Callable[[bytes | None], Iterable[bytes]]) -> DataFrame:
    """``docs`` (with text) and __sums: the summed ``x`` of each text's tokens in ``table`` (w, x array<double>).

    For tables too large to broadcast: tokens meet the table in a shuffle. A token that
    very many texts hold is a large group on their side alone, which adaptive execution splits.
    """
    numbered = stash(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")

    def make():
        def run(batch):
            rows, words = [], []
            for row, data in zip(batch.column("__row").to_pylist(), raw(batch, "text"), strict=True):
                own = list(tokens_of(data))
                rows += [row] * len(own)
                words += own
            return [rows, words]

        return run

    tokens = emit(numbered.select("__row", "text"), "__row bigint, w binary", make)
    each = tokens.join(table.select("w", F.posexplode("x").alias("i", "v")), "w").groupBy("__row", "i").agg(F.sum("v").alias("v"))
    width = table.select(F.max(F.size("x"))).first()[0] or 0
    by_place = F.map_from_entries(F.collect_list(F.struct("i", "v")))
    sums = each.groupBy("__row").agg(by_place.alias("own")).select("__row", F.array(*[F.coalesce(F.col("own")[i], F.lit(0.0)) for i in range(width)]).alias("__sums"))
    zero = F.array_repeat(F.lit(0.0), width)
    return numbered.join(sums, "__row", "left").withColumn("__sums", F.coalesce("__sums", zero)).drop("__row")


def emit(df: DataFrame, schema: str | T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """Rows computed from Arrow batches: ``make()`` runs once in each task, its result on each batch gives columns."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names, types = [f.name for f in kind], [_arrow(f.dataType) for f in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            if batch.num_rows and (cols := fn(batch)) and len(cols[0]):
                yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in zip(cols, types, strict=True)], names=names)

    return df.mapInArrow(run, kind)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of equal keys of sorted batches, as tables; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    now: tuple | None = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()] if batch.num_rows else []
        for start, end in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(int(c[start]) for c in columns)
            if held and key != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = key
            held.append(batch.slice(start, end - start))
    if held:
        yield now, pa.Table.from_batches(held)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.field("element", _arrow(kind.elementType), nullable=True))
    if isinstance(kind, T.StructType):
        return pa.struct([pa.field(f.name, _arrow(f.dataType)) for f in kind])
    return {
        T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(), T.FloatType(): pa.float32(),
        T.StringType(): pa.string(), T.BinaryType(): pa.binary(), T.BooleanType(): pa.bool_(),
    }[kind]


def held_out(doc_id: str = "doc_id"):
    """True where crc32 of the id as text leaves 2 when divided by 4; such rows are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))
