"""Counts and first names of the callers and callees of names, from call sites in batches, whole columns at a time."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a call site's code says: how near its ends are (0 to 2), whether it is inferred, its side, whether a symbol has its
#: other end, whether it counts, and whether that symbol has no name.
NEAR, INFERRED, SIDE, KNOWN, COUNTS, NAMELESS = 3, 4, 8, 16, 32, 64
#: Rows that a task takes at once.
ROWS = 1 << 18

_COLUMNS = ["at", "name", "code", "n"]


def schema(sides: list[tuple[str, str]]) -> str:
    """Columns of a side: its count, whether one is inferred, and its names."""
    return "fqn string, " + ", ".join(f"{side} long, {side}_inferred boolean, {names} array<string>" for side, names in sides)


def site(code: Column, name: Column) -> Column:
    """A call site as one short string, its code before the name: what a row costs on its way to Python goes by its columns."""
    return F.concat(F.char(code + F.when(name.isNull(), NAMELESS).otherwise(0)), F.coalesce(name, F.lit("")))


def _sites(batch: pa.RecordBatch) -> pa.Table:
    """Rows (at, name, code, n) of those (at, site)."""
    at, sites = batch.column(0), batch.column(1)
    _, offsets, data = sites.buffers()
    code = np.frombuffer(data, np.uint8)[np.frombuffer(offsets, np.int32)[sites.offset : sites.offset + len(sites)]].astype(np.int64)
    names = pc.if_else(pa.array((code & NAMELESS) > 0), pa.scalar(None, pa.string()), pc.utf8_slice_codeunits(sites, 1))
    return pa.Table.from_arrays([at, names, pa.array(code), pa.array((code & COUNTS) // COUNTS)], names=_COLUMNS)


def _crc(at: pa.StringScalar) -> int:
    return zlib.crc32(at.as_py().encode())


def _column(rows: pa.Table, name: str) -> pa.Array:
    found = rows.column(name).combine_chunks()
    return pa.concat_arrays(found.chunks) if isinstance(found, pa.ChunkedArray) else found


def _firsts(rows: pa.Table, most: int, sides: int):
    """(names asked about, counts and inferred by side and name, and of the names that stay: group, nearness, rank; names by rank).

    A group is a side and a name asked about; what stays is in order of group, nearness and name, each name once, nearest first."""
    at, code, n = _column(rows, "at").dictionary_encode(), _column(rows, "code").to_numpy(), _column(rows, "n").to_numpy()
    asked = len(at.dictionary)
    group = (code & SIDE) // SIDE * asked + at.indices.to_numpy().astype(np.int64)
    counts, inferred = np.zeros(sides * asked, np.int64), np.zeros(sides * asked, bool)
    np.add.at(counts, group, n)
    inferred[group[(code & INFERRED) > 0]] = True
    known = (code & KNOWN) > 0
    names = _column(rows, "name").filter(pa.array(known)).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(names.dictionary, null_placement="at_end")
    rank, size = np.empty(len(order), np.int64), max(1, len(order))
    rank[order.to_numpy()] = np.arange(len(order))
    # each name of a group once, at its nearest; then the nearest first
    pairs = np.sort((group[known] * size + rank[names.indices.to_numpy()]) * (NEAR + 1) + (code[known] & NEAR))
    name, near = np.divmod(pairs, NEAR + 1)
    new = np.ones(len(name), bool)
    new[1:] = name[1:] != name[:-1]
    group, rank = np.divmod(name[new], size)
    placed, rank = np.divmod(np.sort((group * (NEAR + 1) + near[new]) * size + rank), size)
    group, near = np.divmod(placed, NEAR + 1)
    keep = np.arange(len(group)) - np.searchsorted(group, group) < most
    return at.dictionary, counts, inferred, group[keep], near[keep], rank[keep], names.dictionary.take(order)


def _reduced(rows: pa.Table, most: int, sides: int) -> pa.Table:
    """Rows of few names as few: what is known of their counts, and the names that may be among the first."""
    at, counts, inferred, group, near, rank, names = _firsts(rows, most, sides)
    told = np.flatnonzero((counts > 0) | inferred)
    every = np.concatenate([told, group])
    code = every // len(at) * SIDE + np.concatenate([inferred[told] * INFERRED, near + KNOWN])
    name = pa.concat_arrays([pa.nulls(len(told), names.type), names.take(pa.array(rank))])
    n = np.concatenate([counts[told], np.zeros(len(group), np.int64)])
    return pa.Table.from_arrays([at.take(pa.array(every % len(at))), name, pa.array(code), pa.array(n)], names=_COLUMNS)


def _told(rows: pa.Table, most: int, sides: list[tuple[str, str]]) -> pa.RecordBatch:
    at, counts, inferred, group, _, rank, names = _firsts(rows, most, len(sides))
    asked, values = len(at), names.take(pa.array(rank))
    begins = np.searchsorted(group, np.arange(len(counts) + 1))
    columns, called = [at], ["fqn"]
    for k, (side, listed) in enumerate(sides):
        own, ends = slice(k * asked, (k + 1) * asked), begins[k * asked : (k + 1) * asked + 1]
        lists = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), values.slice(ends[0], ends[-1] - ends[0]))
        columns += [pa.array(counts[own]), pa.array(inferred[own]), lists]
        called += [side, f"{side}_inferred", listed]
    return pa.RecordBatch.from_arrays(columns, called)


def told(sides: list[tuple[str, str]], most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (at, site) in order of the CRC-32 of at: a row for each `at`. Names that are equal in it may lie among each other.

    What is held is bounded: some ROWS rows are taken at once, up to the last number among them; one of more rows is reduced on the way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(_sites(batch))
            n += batch.num_rows
            if n < ROWS:
                continue
            rows = pa.concat_tables(held)
            at = _column(rows, "at")
            last, crc = pc.index(pc.equal(at, at[-1]), True).as_py(), _crc(at[-1])
            while last and _crc(at[last - 1]) == crc:
                last -= 1
            if last:
                yield _told(rows.slice(0, last), most, sides)
            rest = rows.slice(last)
            held = [_reduced(rest, most, len(sides)) if 2 * rest.num_rows > ROWS else rest.combine_chunks()]
            n = held[0].num_rows
        if n:
            yield _told(pa.concat_tables(held), most, sides)

    return run
