"""Removal of repeated byte strings, decided by suffix arrays.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts anywhere else: in another document, another row or
elsewhere in the same text. Texts count as UTF-8 bytes and matches never cross documents.

1. Every window of WIDTH bytes has an anchor: the run of ``GRAM`` bytes in it of smallest hash (leftmost if equal). Equal
   windows have equal anchors at equal distance, so only windows of equal anchors have to be compared. The windows of one
   occurrence of an anchor are neighbours; the bytes that they cover are its extent. Anchors that occur once are left out:
   a bit table of fixed size keeps most of them from being written at all.
2. Extents that occur twice are repeated as a whole. What is left are anchors with several different extents, at least one
   of which occurs once. One copy of each of those extents is cut out of its text and sent to its anchor's group.
3. A group's extents are written one after the other, each stretch that all of them share around the anchor as a single
   symbol, and sorted as one suffix array by linear grouping (``suffixes.py``). A window is repeated if its suffix shares
   enough symbols with a neighbour in that order; as the anchor's symbol is among them, the neighbour is another extent.
4. Groups of more than ``MEMBERS`` extents (a passage that very many documents share, each in its own surroundings) don't
   go to one task: their windows are counted by two 64-bit hashes of their whole content instead.
5. The repeated runs of a document are joined to it and cut out.

Work grows with the text; a task holds one text and one group of at most MEMBERS extents
of less than two windows each. Anchors of different content and equal 64-bit hash only meet in one group; two different
extents of one anchor count as equal if their 64-bit hashes are equal as well.

Defined results: a null text counts as empty and loses nothing, as do texts shorter than WIDTH; rows with equal id and
text are rows of their own, so their windows start twice; ids may be null or repeat; other columns are not read; an empty
table gives an empty one. What is left of a text after cutting need not be valid UTF-8 and is therefore binary.
"""

from __future__ import annotations

import hashlib
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalake.llm.native import bit_table, may_occur
from catalake.llm.shared import written
from catalake.llm.streams import groups
from catalake.llm.suffixes import suffix_order
from catalake.llm.wordsets import ByteHashes, pieces

WIDTH = 200
GRAM = 64
MEMBERS = 1024
#: Longs of the bit tables: 2^24 bits each, whatever the input.
CELLS = 1 << 18
#: Symbols of a group's text: the end of all, the end of an extent, what all extents share; bytes 0 and 1 are raised.
_LAST, _CUT, _SHARED = "\0", "\1", "\u0200"
_RAISED = {0: "\u0100", 1: "\u0101"}
_PLACE = np.uint64((1 << 40) - 1)
_ROW = ["doc_id", "mark"]
_EXTENT = "doc_id long, mark long, at int, size int, lead int, gram long, whole long"


def _least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours, by doubling."""
    done = 1
    while done * 2 <= size:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    return np.minimum(values[: len(values) - (size - done)], values[size - done :]) if done < size else values


def _extents(data: np.ndarray, offsets: np.ndarray):
    """(text number, first byte, bytes, bytes before the anchor, hash of the anchor, hash of the extent) as arrays."""
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - WIDTH + 1, 0)
    if not counts.sum():
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)] * 2
    hashes = ByteHashes(data)
    every = np.arange(len(data) - GRAM + 1)
    grams = hashes.of(every, every + GRAM)
    least = _least((grams & ~_PLACE) | every.astype(np.uint64), WIDTH - GRAM + 1)
    text = np.repeat(np.arange(len(sizes)), counts)
    start = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + offsets[:-1][text]
    anchor = (least[start] & _PLACE).astype(np.int64)
    new = np.ones(len(start), dtype=bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    low, high = start[first], start[np.append(first[1:], len(start)) - 1] + WIDTH
    return text[first], low - offsets[:-1][text[first]], high - low, anchor[first] - low, grams[anchor[first]], hashes.of(low, high)


def _marked(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, text); rows of equal id and mark have equal texts."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def extents(marked: DataFrame) -> DataFrame:
    """The extent of every occurrence of an anchor."""

    def found(batches):
        for batch in batches:
            row = 0
            for data, offsets in pieces(batch.column(2)):
                text, at, size, lead, gram, whole = _extents(data, offsets)
                rows = pa.array(text + row)
                row += len(offsets) - 1
                yield pa.record_batch(
                    [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at, pa.int32()), pa.array(size, pa.int32()),
                     pa.array(lead, pa.int32()), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64))],
                    names=[*_ROW, "at", "size", "lead", "gram", "whole"],
                )

    return marked.mapInArrow(found, _EXTENT)


def repeated_starts(members: list[bytes], leads: list[int], asked: list[bool]) -> list[np.ndarray]:
    """For each asked extent of one anchor, the windows (by first byte) that also start in another of these extents.

    ``leads`` are the bytes before the anchor. The extents are different and two or more.
    """
    lefts = [m[:lead][::-1] for m, lead in zip(members, leads, strict=True)]
    rights = [m[lead + GRAM :] for m, lead in zip(members, leads, strict=True)]
    left = len(commonprefix([min(lefts), max(lefts)]))
    right = len(commonprefix([min(rights), max(rights)]))
    text, begun = [], []
    for member, lead in zip(members, leads, strict=True):
        begun.append(begun[-1] + len(text[-1]) if begun else 0)
        before, behind = (part.decode("latin-1").translate(_RAISED) for part in (member[: lead - left], member[lead + GRAM + right :]))
        text.append(f"{before}{_SHARED}{behind}{_CUT}")
    symbols = "".join(text) + _LAST
    order = suffix_order(list(map(ord, symbols)))
    rank = [0] * len(order)
    for at, i in enumerate(order):
        rank[i] = at
    order.append(order[-2])

    def shared_with_neighbours(i: int, needed: int) -> bool:
        """Whether a neighbour in suffix order begins with the same symbols."""
        at, mine = rank[i], symbols[i : i + needed]
        return symbols.startswith(mine, order[at - 1]) or symbols.startswith(mine, order[at + 1])

    out = []
    for member, lead, start, wanted in zip(members, leads, begun, asked, strict=True):
        found = []
        merged, end = lead - left, lead + GRAM + right
        for window in range(len(member) - WIDTH + 1 if wanted else 0):
            beyond = max(window + WIDTH - end, 0)
            if window >= merged and not beyond or shared_with_neighbours(start + min(window, merged), max(merged - window, 0) + 1 + beyond):
                found.append(window)
        out.append(np.array(found, np.int64))
    return out


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes and sizes of what these windows cover, one row for neighbouring windows."""
    first = np.flatnonzero(np.diff(starts, prepend=-2) != 1)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] - starts[first] + WIDTH


_RUN = "doc_id long, mark long, at int, size int"
_RUN_TYPES = {"doc_id": pa.int64(), "mark": pa.int64(), "at": pa.int32(), "size": pa.int32()}
_ROWS = 10_000


def _batch(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types.values(), strict=True)], names=list(types))


def _decided(batches):
    """Runs of repeated windows, from the extents of whole groups."""
    out: list[tuple] = []
    for _, parts in groups(batches, "gram"):
        rows = pa.Table.from_batches(parts).to_pydict()
        # equal rows of a table give equal extents, which are known to be repeated
        numbers = list({b: i for i, b in enumerate(rows["bytes"])}.values())
        asked = [rows["times"][i] == 1 for i in numbers]
        found = repeated_starts([rows["bytes"][i] for i in numbers], [rows["lead"][i] for i in numbers], asked)
        for i, starts in zip(numbers, found, strict=True):
            if len(starts):
                first, sizes = _runs(starts)
                out += [(rows["doc_id"][i], rows["mark"][i], at + rows["at"][i], size) for at, size in zip(first.tolist(), sizes.tolist(), strict=True)]
        if len(out) >= _ROWS:
            yield _batch(out, _RUN_TYPES)
            out = []
    if out:
        yield _batch(out, _RUN_TYPES)


def _windows(batches):
    """Every window of some extents with two hashes of its bytes."""
    for batch in batches:
        for i, whole in enumerate(batch.column(batch.schema.get_field_index("bytes"))):
            data = np.frombuffer(whole.as_py(), np.uint8)
            start = np.arange(len(data) - WIDTH + 1)
            one, two = ByteHashes(data), ByteHashes(data ^ np.uint8(0x5A))
            row = pa.array(np.full(len(start), i))
            yield pa.record_batch(
                [batch.column(0).take(row), batch.column(1).take(row),
                 pa.array(start + batch.column(2)[i].as_py(), pa.int32()), batch.column(4).take(row),
                 pa.array(one.of(start, start + WIDTH).view(np.int64)), pa.array(two.of(start, start + WIDTH).view(np.int64))],
                names=[*_ROW, "at", "times", "one", "two"],
            )


def repeated_runs(docs: DataFrame, members: int = MEMBERS) -> DataFrame:
    """(doc_id, mark, at, size): runs of bytes to remove, which may overlap; ``mark`` is a hash of the text."""
    marked = _marked(docs)
    known = extents(marked)
    twice = written(known.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram"), "anchors")
    bits = bit_table(twice.select(F.xxhash64("gram").alias("key")), "key", CELLS).scalar()
    live = written(known.filter(may_occur(bits, F.xxhash64("gram"), CELLS)), "extents")
    wholes = written(
        live.groupBy("gram", "whole").agg(F.count("*").alias("times"), F.min(F.struct(*_ROW, "at", "size", "lead")).alias("first")),
        "wholes",
    )
    copies = live.join(wholes.filter("times > 1").select("gram", "whole"), ["gram", "whole"], "left_semi").select(*_ROW, "at", "size")

    mixed = wholes.groupBy("gram").agg(F.count("*").alias("members"), F.min("times").alias("least"))
    mixed = mixed.filter("members > 1 and least = 1").select("gram", "members")
    wanted = wholes.join(mixed, "gram").select("gram", "members", "times", "first.*")
    lists = wanted.groupBy(*_ROW).agg(F.collect_list(F.struct("gram", "members", "times", "at", "size", "lead")).alias("wanted"))
    lists = written(lists, "wanted")
    cut = _cut_out(_only(marked, lists), lists)
    cut = written(cut, "cut")
    small = cut.filter(F.col("members") <= members).repartition("gram").sortWithinPartitions("gram")
    decided = small.mapInArrow(_decided, _RUN)

    windows = cut.filter(F.col("members") > members).mapInArrow(
        _windows, "doc_id long, mark long, at int, times long, one long, two long"
    )
    seen = windows.groupBy("one", "two").agg(F.count("*").alias("n")).filter("n > 1")
    counted = windows.filter("times = 1").join(seen, ["one", "two"], "left_semi")
    counted = counted.select(*_ROW, "at", F.lit(WIDTH).cast("int").alias("size"))
    return copies.union(decided).union(counted)


def _key() -> Column:
    return F.xxhash64(*_ROW)


def _only(marked: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among ``keys``."""
    return marked.filter(may_occur(bit_table(keys.select(_key().alias("key")), "key", CELLS).scalar(), _key(), CELLS))


def _same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def _cut_out(marked: DataFrame, lists: DataFrame) -> DataFrame:
    """The bytes of wanted extents."""

    types = _RUN_TYPES | {"lead": pa.int32(), "times": pa.int64(), "members": pa.int64(), "gram": pa.int64(), "bytes": pa.binary()}
    del types["size"]

    def cut(batches):
        for batch in batches:
            rows = []
            for ident, mark, text, wanted in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = text.encode()
                for w in wanted:
                    whole = data[w["at"] : w["at"] + w["size"]]
                    rows.append((ident, mark, w["at"], w["lead"], w["times"], w["members"], w["gram"], whole))
            if rows:
                yield _batch(rows, types)

    both = marked.join(lists, _same_row(marked, lists)).select(marked["doc_id"], marked["mark"], "text", "wanted")
    return both.mapInArrow(
        cut, "doc_id long, mark long, at int, lead int, times long, members long, gram long, bytes binary"
    )


def _kept(data: bytes, runs: list[dict]) -> tuple[bytes, int]:
    """The bytes that no run covers, and how many maximal runs go."""
    kept, spans, end = [], 0, -1
    for at, size in sorted((r["at"], r["size"]) for r in runs):
        if at > end:
            kept.append(data[max(end, 0) : at])
            spans += 1
        end = max(end, at + size)
    return b"".join([*kept, data[end:]]), spans


def without_repeats(docs: DataFrame, members: int = MEMBERS) -> DataFrame:
    """Every row of ``docs`` as (doc_id, kept binary, n_bytes, n_removed, n_spans, kept_sha256)."""
    marked = _marked(docs)
    runs = written(repeated_runs(docs, members).groupBy(*_ROW).agg(F.collect_set(F.struct("at", "size")).alias("runs")), "runs")
    bits = bit_table(runs.select(_key().alias("key")), "key", CELLS).scalar()
    maybe = may_occur(bits, _key(), CELLS)
    touched = marked.filter(maybe)
    joined = touched.join(runs, _same_row(touched, runs), "left").select(touched["doc_id"], "text", "runs")
    whole = marked.filter(~maybe).select("doc_id", "text", F.lit(None).cast(runs.schema["runs"].dataType).alias("runs"))

    types = {"doc_id": pa.int64(), "kept": pa.binary(), "n_bytes": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(),
             "kept_sha256": pa.string()}

    def cut(batches):
        for batch in batches:
            rows = []
            for ident, text, runs in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                data = text.encode()
                left, spans = _kept(data, runs) if runs else (data, 0)
                rows.append((ident, left, len(data), len(data) - len(left), spans, hashlib.sha256(left).hexdigest()))
            if rows:
                yield _batch(rows, types)

    return joined.union(whole).mapInArrow(
        cut, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    )
