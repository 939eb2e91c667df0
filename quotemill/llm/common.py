"""What the operators share: column names that cannot clash, batch sizes, and the two word definitions."""

from __future__ import annotations

import contextlib
import ctypes
import itertools
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quotemill.session import tune

# Rows of one Arrow batch: texts may be long, and a batch is held in the Python worker as a whole.
BATCH_ROWS = 512
BATCH_BYTES = 32 << 20

# Bytes 0x09-0x0D and 0x20 separate words of the plain kind; ``bytes.split()`` cuts at exactly these.
SPACES = " \t\n\x0b\f\r"

# The strict kind: ASCII letters (lower-cased) and digits and every byte from 0x80 are word bytes, the rest separate.
_STRICT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
STRICT_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def prepare(spark: SparkSession) -> SparkSession:
    """Session settings of the operators; the cluster's own sizing is left alone."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that the frame does not have yet, compared as Spark does (ignoring case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        free = next(n for n in itertools.chain([name], (f"{name}_{i}" for i in itertools.count(1))) if n.lower() not in taken)
        taken.add(free.lower())
        out.append(free)
    return out


def only(df: DataFrame, **cols: str) -> DataFrame:
    """Exactly the named columns under the names an operator works with; all other columns are left behind."""
    return df.select(*[df[f"`{c}`"].alias(name) for name, c in cols.items()])


def texts(batch: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text of an Arrow batch; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(batch.type) else pa.binary()
    return [b or b"" for b in batch.cast(kind).to_pylist()]


def plain_words(text: bytes) -> list[bytes]:
    """Words between the separators 0x09-0x0D and 0x20."""
    return text.split()


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z, all other bytes as they are."""
    return text.lower()


def strict_words(text: bytes) -> list[bytes]:
    """Lower-cased words of the strict kind (``STRICT_WORD``)."""
    return text.translate(_STRICT).split()


_resident: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Return freed memory of the worker to the system, as far as its allocators can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def resident(operator: str, forget: Callable[[], None] | None = None) -> None:
    """Say that this worker works for ``operator``: what other operators have left in it goes, by their ``forget``.

    Python workers live on from stage to stage, and what each stage remembers would add up.
    """
    others = [name for name in _resident if name != operator]
    for name in others:
        _resident.pop(name)()
    if forget is not None:
        _resident[operator] = forget
    if others:
        give_back()


def leaving(batches: Iterator, *forget: Callable[[], None]) -> Iterator:
    """The batches of a task; after the last one what the task remembered goes, and its memory is given back.

    More workers than cores wait for tasks in turn, so what each kept between its tasks would count as often as there are workers.
    """
    try:
        yield from batches
    finally:
        for drop in forget:
            drop()
        give_back()


def forgetting(batches: Iterator, *tables: dict) -> Iterator:
    """The batches of a task; after the last one the remembering tables are emptied."""
    resident("")
    yield from leaving(batches, *[table.clear for table in tables])


def first_texts(rows: DataFrame, most: int, *cols: Column) -> DataFrame:
    """``cols`` of the ``most`` first distinct texts in the order of their hash, or of all if there are fewer.

    Column ``text`` must not be null.  Hash order is the same for any partitioning.  Distinct hashes are counted and cut
    before a text is looked at, so copies neither shrink the sample nor are worked on twice.
    """
    h = F.shiftrightunsigned(F.xxhash64("text"), 1)  # never negative, so that threshold and order agree
    distinct = rows.select(h.alias("h")).distinct().count()
    # The threshold leaves somewhat more than ``most`` hashes in all, so that the exact cut sorts few rows at any size.
    share = min(1.0, (1.5 * most + 100) / max(distinct, 1))
    chosen = rows.select("text").filter(F.shiftright(h, 10) <= int(share * (1 << 53))).distinct()
    return chosen.select(h.alias("h"), *cols).dropDuplicates(["h"]).orderBy("h").limit(most).drop("h")


def digest_of(ids: Column) -> Column:
    """Lowercase hex SHA-256 of the decimal numbers of an array column, joined by commas."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)
