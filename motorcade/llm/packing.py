"""Packing documents into token windows by Karmarkar-Karp multiway differencing.

Windows that a long document fills alone are cut from it at once. What is left of each document joins a block, whole.
Differencing merges partial partitions of a block, the largest sums of one with the smallest of the other, into
near-equal windows. Where the fullest exceeds the capacity the window count rises, as long as padding stays under
MAX_PADDING of the block. What then still exceeds it is cut off its window's largest piece and goes, whole where
it fits, to the windows with room. Without cutting, the window count rises until every window fits. A task's last
block may be too small for a share of padding; there, full windows are cut and the odd tail goes to sequences whose
lengths are powers of two, which need no padding.

Each task packs the rows it reads, block by block, so no shuffle is needed and memory is bounded by BLOCK_TOKENS and
the longest document. Sequence ids are the task's partition number and a running number, the same when a task is run
again on the same rows.

Edge cases: a null or empty text is the end id alone; runs of blanks of any length are encoded whole; repeated rows
are packed once each; an empty table has no pieces; ids may have any type; only the id and text columns are read.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from motorcade.llm.common import bounded

CAPACITY = 1024
END_ID = 0
#: A block is packed when it has so many remainders and holds so many windows, or holds so many tokens.
BLOCK = 1024
BLOCK_WINDOWS = 128
BLOCK_TOKENS = 2_000_000
#: Share of a block's tokens up to which more windows are opened rather than pieces cut.
MAX_PADDING = 0.01
#: Blanks in a row from which the fast library's pattern engine, which keeps a step for each, is passed by.
LONG_RUN = 100_000
#: Fixed value: what a blank is to the pattern below.
BLANKS = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_RUN)
#: Fixed value: how byte-level BPE cuts text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Encoder:
    """Ids that the tokenizer file gives; texts without its special strings go through a faster library that has the
    same vocabulary as ranks."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = tuple(x["content"] for x in spec["added_tokens"])
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) < LONG_RUN:
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        out, at = [], 0
        for m in BLANKS.finditer(text):
            start, end = m.span()
            end -= end < len(text)  # the last blank belongs to what follows it
            out += self.fast.encode_ordinary(text[at:start])
            out += self.fast._encode_single_piece(text[start:end])
            at = end
        return np.array(out + self.fast.encode_ordinary(text[at:]), np.uint32)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Split items into k groups of near-equal sums: take the two partial partitions whose sums differ most, and join
    the largest sums of one with the smallest of the other, until one partition is left."""
    if not sizes:
        return [[] for _ in range(k)]
    kids: list[tuple[int, int]] = []  # groups over the items' own ones, each of two groups
    n = len(sizes)
    heap = [(-s, i, np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tick = n
    while len(heap) > 1:
        _, _, a, ga = heapq.heappop(heap)
        _, _, b, gb = heapq.heappop(heap)
        over = len(a) + len(b) - k  # sums that meet; the rest meet nothing
        if over > 0:
            met = np.arange(len(a) - over, len(a))
            back = k - 1 - met
            sums, groups = a.copy(), ga.copy()
            sums[met] += b[back]
            for x, y in zip(met, back, strict=True):
                kids.append((int(ga[x]), int(gb[y])))
                groups[x] = n + len(kids) - 1
            free = np.setdiff1d(np.arange(len(b)), back, assume_unique=True)
            sums, groups = np.concatenate([sums, b[free]]), np.concatenate([groups, gb[free]])
        else:
            sums, groups = np.concatenate([a, b]), np.concatenate([ga, gb])
        order = np.argsort(-sums, kind="stable")
        sums, groups = sums[order], groups[order]
        heapq.heappush(heap, (-int(sums[0] - (sums[-1] if len(sums) == k else 0)), tick, sums, groups))
        tick += 1
    out = []
    for g in heap[0][3]:
        items, todo = [], [int(g)]
        while todo:
            x = todo.pop()
            todo.extend(kids[x - n]) if x >= n else items.append(x)
        out.append(items)
    return out + [[] for _ in range(k - len(out))]


Piece = tuple[int, int, int]  # item, start, length


def pack_whole(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of whole items, none over capacity: one window more whenever the fullest one exceeds it."""
    if any(s > capacity for s in sizes):
        raise ValueError("an item exceeds the capacity")
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while sizes:
        groups = differencing(sizes, k)
        over = max(sum(sizes[i] for i in g) for g in groups)
        if over <= capacity:
            return [g for g in groups if g]
        k += 1
    return []


def pack_cut(sizes: list[int], capacity: int) -> list[list[Piece]]:
    """Windows of pieces: whole items where differencing fits them with little padding, else what exceeds a window is
    cut off and fills others."""
    total = sum(sizes)
    least, most = -(-total // capacity), int(total / capacity / (1 - MAX_PADDING))
    if least > most:
        return pack_full(sizes, capacity)
    for k in dict.fromkeys((least, most)):
        groups = differencing(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            break
    windows, over, room = [], [], []
    for n, g in enumerate(groups):
        held = sorted(((i, 0, sizes[i]) for i in g), key=lambda p: p[2])
        more = sum(p[2] for p in held) - capacity
        if more < 0:
            room.append((-more, n))
        while more > 0:
            i, _, size = held.pop()
            cut = min(size, more)
            over.append((i, size - cut, cut))
            more -= cut
            if cut < size:
                held.append((i, 0, size - cut))
        windows.append(held)
    room.sort()
    for i, at, size in sorted(over, key=lambda p: -p[2]):
        while size:
            place = min(bisect_left(room, (size, -1)), len(room) - 1)
            free, n = room.pop(place)
            took = min(free, size)
            windows[n].append((i, at, took))
            at, size = at + took, size - took
            if free > took:
                insort(room, (free - took, n))
    return windows


def pack_full(sizes: list[int], capacity: int) -> list[list[Piece]]:
    """Windows filled exactly and an odd tail in lengths that are powers of two."""
    k, tail = divmod(sum(sizes), capacity)
    windows: list[list[Piece]] = []
    spare: list[Piece] = []
    for g in differencing(sizes, k) if k else [list(range(len(sizes)))]:
        room, held = capacity if k else 0, []
        for i in sorted(g, key=lambda i: -sizes[i]):
            take = min(room, sizes[i])
            if take:
                held.append((i, 0, take))
                room -= take
            if take < sizes[i]:
                spare.append((i, take, sizes[i] - take))
        if k:
            windows.append(held)
    spare.sort(key=lambda p: -p[2])

    def fill(held: list[Piece], room: int) -> None:
        while room and spare:
            i, at, n = spare.pop()
            held.append((i, at, min(n, room)))
            if n > room:
                spare.append((i, at + room, n - room))
            room -= min(n, room)

    for held in windows:
        fill(held, capacity - sum(p[2] for p in held))
    for bit in range(tail.bit_length() - 1, -1, -1):
        if tail >> bit & 1:
            fill(held := [], 1 << bit)
            windows.append(held)
    return windows


def pack(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", cut: bool = True, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    schema = f"`{id_col}` {dict(df.dtypes)[id_col]}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    id_type = to_arrow_type(df.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path)
        seq = TaskContext.get().partitionId() << 33
        rows: list[tuple] = []
        block: list[tuple] = []  # id, ids left, their start, tokens of the document
        held = 0

        def put(doc, ids, at, n_doc, seq, offset):
            rows.append((doc, at, len(ids), zlib.crc32(ids.tobytes()), n_doc, seq, offset) + ((ids.astype(np.int32),) if with_ids else ()))

        def close() -> None:
            nonlocal seq, held
            sizes = [len(x[1]) for x in block]
            packed = pack_cut(sizes, capacity) if cut else [[(i, 0, sizes[i]) for i in g] for g in pack_whole(sizes, capacity)]
            for window in packed:
                offset = 0
                for i, at, n in window:
                    doc, ids, start, n_doc = block[i]
                    put(doc, ids[at : at + n], start + at, n_doc, seq, offset)
                    offset += n
                seq += 1
            block.clear()
            held = 0

        def flush() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            out = [pa.array(cols[0], id_type), *[pa.array(c, pa.int64()) for c in cols[1:7]]] + ([pa.array(cols[7], pa.list_(pa.int32()))] if with_ids else [])
            rows.clear()
            return pa.RecordBatch.from_arrays(out, names + ["ids"] * with_ids)

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(enc.ids(text), np.uint32(END_ID))
                whole = len(ids) // capacity * capacity
                for at in range(0, whole, capacity):
                    put(doc, ids[at : at + capacity], at, len(ids), seq, 0)
                    seq += 1
                if whole < len(ids):
                    block.append((doc, ids[whole:].copy(), whole, len(ids)))
                    held += len(ids) - whole
                if len(block) >= BLOCK and held >= BLOCK_WINDOWS * capacity or held >= BLOCK_TOKENS:
                    close()
                if len(rows) >= 20_000:
                    yield flush()
        if block:
            close()
        if rows:
            yield flush()

    return bounded(df).select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, schema)
