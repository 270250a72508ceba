"""What the text operators share: reading, hash folds, and chunked Arrow passes over a text column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rasterloom.operators.ranking import hash_sample

#: Characters of text a Python worker handles at once; a longer text is a chunk of its own.
CHUNK_CHARS = 4_000_000

WORD = "[^\\x20\\x09-\\x0D]+"


def find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package when the driver was started in another folder."""
    home = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH", ""), home]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(n)), F.lit(-1)).cast("int")


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bounded_sample(df: DataFrame, stratum: str, most: int, even: float) -> DataFrame:
    """At most ``most`` rows of ``df``, all if it has no more: in each stratum those with the smallest hash of the whole row.

    The share ``even`` of the room is dealt evenly to the strata, the rest by their size. Rows equal in all columns come or go together and only
    come if they fit. Hashes are ranked, never texts.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(F.col(f"`{stratum}`")).count().collect()}
    n = sum(sizes.values())
    if n <= most:
        return df
    key = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    kept = F.lit(False)
    for value, size in sizes.items():
        room = int(most * even) // len(sizes) + int(most * (1 - even)) * size // n
        own = F.col(f"`{stratum}`") == F.lit(value)
        if size > room:
            # the first hash that no longer fits
            above = df.filter(own).select(key.alias("h")).orderBy("h").limit(room + 1).agg(F.max("h")).first()[0]
            own = own & (key < F.lit(above))
        kept = kept | own
    return df.filter(kept)


def sampled(rows: DataFrame, keys: DataFrame, key: str, stratum: str, most: int, even: float) -> DataFrame:
    """``rows`` (key, text) of at most ``most`` of the ``keys`` (key, stratum), with their stratum; a NULL key is never taken.

    The keys are drawn by their hash, never by a text, and only they are shuffled; being at most ``most`` they go to the rows as a broadcast, so no text
    moves. ``even`` deals room as in ``bounded_sample``, which also cuts the result where repeated keys bring more rows than fit.
    """
    keys = keys.select(F.col(f"`{key}`").alias(key), F.col(f"`{stratum}`").alias(stratum)).filter(F.col(f"`{key}`").isNotNull())
    sizes = {r[0]: r[1] for r in keys.groupBy(stratum).count().collect()}
    n = sum(sizes.values())
    if n > most:
        room = {v: int(most * even) // len(sizes) + int(most * (1 - even)) * size // n for v, size in sizes.items()}
        rooms = F.create_map(*[F.lit(x) for pair in room.items() for x in pair])
        keys = hash_sample(keys, "sample", [key], rooms[F.col(stratum)], [stratum])
    picked = rows.join(F.broadcast(keys), key)
    return picked if picked.select(key).count() <= most else bounded_sample(picked, stratum, most, even)


def chunks(texts: list[str | None], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of at most ``most`` characters together, one text at least."""
    return ranges([len(t or "") for t in texts], most)


def ranges(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """``chunks`` of texts of these lengths."""
    start, size = 0, 0
    for i, n in enumerate(lengths):
        n += 64
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def map_text(
    df: DataFrame, column: str, fields: list[tuple[str, str]], make: Callable[[list[str | None]], list], most: int = CHUNK_CHARS
) -> DataFrame:
    """``df`` with the columns ``fields`` (name, type) that ``make`` gives for each list of texts.

    All other columns pass unchanged; one named like a new column is replaced. Rows keep their partition: no shuffle. A text column that stays goes
    to the task once, as the column and as the text to read; a worker holds Python strings of one chunk at a time.
    """
    find_package(df.sparkSession)
    names = {n.lower() for n, _ in fields}
    kept = [c for c in df.columns if c.lower() not in names]
    base = df.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(column) if column in kept and isinstance(base.schema[column].dataType, T.StringType) else len(kept)
    if at == len(kept):
        base = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{column}`").cast("string").alias(free_name(df, "_src")))
    added = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields])
    schema = T.StructType([*base.schema.fields[: len(kept)], *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(added)
        for batch in batches:
            texts = batch.column(at)
            for a, b in ranges(pc.utf8_length(texts).fill_null(0).to_pylist(), most):
                own = make(texts.slice(a, b - a).to_pylist())
                new = [x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(own, out, strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(kept)], *new], names=[*kept, *out.names])

    return base.mapInArrow(run, schema)
