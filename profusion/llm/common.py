"""What several training-data operators share: Arrow slices, tokens, hashes, document ids."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of the contracts: ``[\x20\x09-\x0D]``.
SPACE = r"[\x20\x09-\x0D]"
#: Rows without an id count as one document that sorts after all others.
NO_ID = (1 << 63) - 1
SLICE_BYTES = 2 << 20
END_TOKEN = np.uint64(xxhash.xxh3_64_intdigest(b"\n"))


def fresh(name: str, *frames) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_names(docs, *names: str) -> list[str]:
    """Names for new columns: those asked for, or the next that ``docs`` leaves free. Given columns are never replaced."""
    return [fresh(name, docs) for name in names]


def task(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """A task's function that gives its memory back at the end; Python workers are used again by later stages."""

    @functools.wraps(run)
    def own(*args):
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):
                pass  # another C library than glibc

    return own


def id_or_last(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NO_ID))


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that no piece has much more than ``most`` bytes in ``column`` (one row at least)."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(size):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        yield batch.slice(at, end - at)
        at = end


def hash_strings(strings: pa.Array) -> np.ndarray:
    """64-bit hashes of distinct strings."""
    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(x) for x in strings.to_pylist()), np.uint64, len(strings))


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text (A-Z lower-cased, cut at white space) and the row offsets.

    Each distinct word of the slice is hashed once; nulls and empty texts have no words.
    """
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(parts, pa.ChunkedArray):
        parts = parts.combine_chunks()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    flat = parts.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = pc.dictionary_encode(flat)
    hashes = hash_strings(coded.dictionary) if len(coded.dictionary) else np.zeros(0, np.uint64)
    flat_hash = hashes[coded.indices.to_numpy()] if len(flat) else np.zeros(0, np.uint64)
    empty = pc.equal(flat, "").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, bool)
    if empty.any():  # the text began or ended with white space
        kept = np.concatenate([[0], np.cumsum(~empty)])
        return flat_hash[~empty], kept[offsets]
    return flat_hash, offsets


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: a bijection whose output bits all depend on all input bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def unsigned(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.uint64)


def int_lists(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))
