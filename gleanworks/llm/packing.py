"""Best-fit packing by bin completion.

Documents become token ids, each followed by an end id. Those longer than a
sequence are cut; all pieces are then packed into as few sequences as possible.

The packing is decided on the histogram of piece lengths, which has at most
``capacity`` entries however large the corpus is: best-fit decreasing gives the
incumbent, and bin completion (branch and bound over undominated fillings
around the largest piece, pruned by a bound on waste) tries to improve on it. A
solution is a list of patterns with repeat counts. Pieces find their place by
their number among the pieces of their length, so no group of equal lengths
ever meets in one task.

Defined cases: null text is empty; an empty document is one piece with the end
id alone; repeated rows and null doc_ids are packed like any other rows; an
empty table gives an empty result; columns other than doc_id and text are not
read, whatever their names. A text is tokenized whole by one task, so it may have 2 GB
at most.
"""

from __future__ import annotations

import bisect
import os
import zlib
from functools import lru_cache
from collections.abc import Iterator
from itertools import accumulate, chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, claim, column, materialise, strings, tidy

CAPACITY = 2048
END_ID = 0
#: Branch-and-bound nodes after which the best solution so far is taken, and
#: after how many of them an incumbent is made of the branch.
NODES, RENEW = 4000, 20
#: Fillings tried around one largest piece, and steps of the search for them. With NODES
#: they bound the time of a search whose tree has no bound; best-fit decreasing stands by.
FILLINGS, STEPS = 24, 4000
#: Chunks whose ids a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 1_000_000
#: Bytes of text that a worker cuts into chunks at once; a chunk takes many times its bytes.
TEXT_BYTES = 1 << 20

# Bytes of UTF-8 that send a text to the tokenizer whole: control characters on
# which str.split() and the tokenizer's pattern may differ, and what begins code
# points from U+0300, whose case or composition may not be their own affair.
_ODD_BYTES = bytes([0, 11, 12, 28, 29, 30, 31, *range(0xCC, 0x100)])
_ODD_STRINGS = ("\x85", "\xa0", "\u0130", "<|")
# Classes of bytes: full stop or comma; another mark; white space; anything else.
_CLASS = bytes(100 if c in b".," else 32 if c in b" \t\n\r" else 119 if c >= 128 or chr(c).isalnum() else 109 for c in range(256))


def _parts(text: str) -> list[str] | None:
    """Chunks of a text whose tokens are theirs; None if it must stay whole."""
    raw = text.encode("utf-8", "replace")
    if len(raw.translate(None, _ODD_BYTES)) != len(raw) or any(x in text for x in _ODD_STRINGS):
        return None
    kinds = raw.translate(_CLASS)
    low = text.lower()
    # Marks beyond ASCII begin with 0xC2 or 0xCB, or are one of two signs.
    if b"dd" in kinds or b"dm" in kinds or b"md" in kinds or b"\xc2" in raw or b"\xcb" in raw or "\u00d7" in text or "\u00f7" in text:
        return low.split()
    return low.replace(".", " . ").replace(",", " , ").split()


class _Ragged:
    """Rows of ids of different lengths, found by a key."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.start = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def add(self, keys: list[str], size: np.ndarray, flat: np.ndarray) -> None:
        first = len(self.number)
        self.number.update(zip(keys, range(first, first + len(keys)), strict=True))
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def codes(self, keys: list[str]) -> np.ndarray:
        """Their numbers; -1 if unknown."""
        return np.fromiter(map(self.number.get, keys, repeat(-1)), np.int64, len(keys))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of these rows, and the rows' lengths."""
        size = self.size[codes]
        ends = np.cumsum(size)
        at = np.repeat(self.start[codes] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        return self.flat[at], size


class ChunkTokenizer:
    """Ids of whole texts, found chunk by chunk.

    The vocabulary's normaliser and pattern never join what white space parts,
    so a text's ids are those of its chunks, one after another. Most chunks
    recur, and each is tokenized once; those not seen yet are tokenized in one
    call, and told apart by the offsets of their tokens. Full stops and commas
    that touch no other mark are tokens of their own and chunks of their own
    here. Where case folding or composition could depend on neighbours (code
    points from U+0300) or special strings may occur, the tokenizer gets the
    whole text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # For chunks that are one word of letters, there is nothing to normalise or split.
        self.lean = Tokenizer(self.tokenizer.model)
        self.lean.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.chunks = _Ragged()

    def _learn(self, chunks: list[str]) -> None:
        for tokenizer, part in ((self.lean, [c for c in chunks if c.isalpha()]), (self.tokenizer, [c for c in chunks if not c.isalpha()])):
            got = tokenizer.encode(" ".join(part), add_special_tokens=False)
            size = np.array([len(c) for c in part], np.int64)
            start = np.cumsum(size + 1) - size - 1
            of = np.searchsorted(start, np.array(got.offsets, np.int64).reshape(-1, 2)[:, 0], "right") - 1
            self.chunks.add(part, np.bincount(of, minlength=len(part)), np.array(got.ids, np.uint32))

    def ids(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's begin (and the last ends)."""
        if len(self.chunks.number) > REMEMBERED:
            self.chunks = _Ragged()
        whole: dict[int, np.ndarray] = {}
        listed = [_parts(t) for t in texts]
        for i, t in enumerate(texts):
            if listed[i] is None:
                whole[i] = np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32)
                listed[i] = []
        chunks = list(chain.from_iterable(listed))
        codes = self.chunks.codes(chunks)
        unseen = np.flatnonzero(codes < 0)
        if len(unseen):
            new = [chunks[i] for i in unseen.tolist()]
            self._learn(list(set(new)))
            codes[unseen] = self.chunks.codes(new)
        flat, size = self.chunks.gather(codes)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0] + [len(x) for x in listed])]
        total = np.diff(ends)
        for i, x in whole.items():
            total[i] = len(x)
        bounds = np.concatenate([[0], np.cumsum(total + 1)]).astype(np.int64)
        out = np.full(bounds[-1], end_id, np.uint32)
        for i, at in enumerate(bounds[:-1].tolist()):
            out[at : at + total[i]] = whole[i] if i in whole else flat[ends[i] : ends[i + 1]]
        return out, bounds


@lru_cache(2)
def worker_tokenizer(path: str) -> ChunkTokenizer:
    """The worker's tokenizer, kept from task to task."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    _made.append(ChunkTokenizer(path))
    return _made[-1]


_made: list[ChunkTokenizer] = []


def _forget() -> None:
    """Chunks go; the tokenizers stay, since loading them takes much memory for a moment."""
    for t in _made:
        t.chunks = _Ragged()


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the task
    and number among the task's pieces of that length; ids too if asked for."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, task int, nth long" + ", ids array<int>" * with_ids

    def run(batches):
        claim("packing", _forget)
        tokenizer = worker_tokenizer(tokenizer_path)
        task = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for block in blocks(batches, most=TEXT_BYTES):
            flat, bounds = tokenizer.ids(strings(block), end_id)
            total = np.diff(bounds)
            n = -(-total // capacity)
            row = np.repeat(np.arange(len(total)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, total[row] - start)
            at = bounds[row] + start
            raw = flat.astype("<u4").tobytes()
            view = memoryview(raw)
            crc = [zlib.crc32(view[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            first = np.searchsorted(ordered, ordered, "left")
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - first + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            out = {
                "doc_id": column(block, "doc_id").take(pa.array(row)),
                "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()),
                "length": pa.array(length, pa.int64()),
                "ids_crc32": pa.array(crc, pa.int64()),
                "task": pa.array(np.full(len(row), task), pa.int32()),
                "nth": pa.array(nth, pa.int64()),
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.concatenate([at, [bounds[-1]]]), pa.int32()), pa.array(flat.view(np.int32)))
            yield pa.RecordBatch.from_pydict(out)
        tidy()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


Pattern = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...) and how many sequences are filled so


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on a histogram. Sequences with equal contents are
    one class, so the work depends on the number of lengths, not of pieces."""
    classes: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple, n: int) -> None:
        if room not in classes:
            classes[room] = []
            bisect.insort(rooms, room)
        classes[room].append((items, n))

    for length in sorted((k for k, v in counts.items() if v), reverse=True):
        left = counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):  # open new sequences
                each = capacity // length
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, ((length, each),), full)
                if rest:
                    put(capacity - rest * length, ((length, rest),), 1)
                left = 0
                continue
            room = rooms[i]
            items, n = classes[room].pop()
            if not classes[room]:
                del classes[room]
                rooms.pop(i)
            each = room // length
            full = min(n, left // each)
            if full:
                put(room - each * length, (*items, (length, each)), full)
                left -= full * each
            if n > full:
                if left:
                    rest = min(left, each)
                    put(room - rest * length, (*items, (length, rest)), 1)
                    left -= rest
                    full += 1
                if n > full:
                    put(room, items, n - full)
    return [(items, n) for group in classes.values() for items, n in group]


def dominates(a: tuple[tuple[int, int], ...], b: tuple[tuple[int, int], ...]) -> bool:
    """Whether filling ``a`` is at least as good as ``b``, whatever else is to be packed:
    b's pieces go into places of the size of a's, so they could change places with them.
    First-fit decreasing decides, so what is said to be dominated is."""
    rooms = [k for k, n in a for _ in range(n)]
    if sum(k * n for k, n in b) > sum(rooms):
        return False
    for k, n in b:
        for _ in range(n):
            i = next((i for i, r in enumerate(rooms) if r >= k), None)
            if i is None:
                return False
            rooms[i] -= k
    return True


def fillings(lengths: list[int], counts: dict[int, int], room: int, most: int = FILLINGS) -> list[tuple[tuple[int, int], ...]]:
    """Undominated ways to fill ``room``: least waste first, and of those the one with
    fewer (larger) pieces. None leaves room for a piece that is still there, and none
    is dominated by one before it. At most ``most`` are returned, of at most four times
    as many found in at most STEPS steps of the search."""
    found: list[tuple[int, int, tuple[tuple[int, int], ...]]] = []
    budget = [STEPS]

    def go(i: int, room: int, chosen: tuple) -> None:
        if len(found) >= most * 4 or budget[0] < 0:
            return
        budget[0] -= 1
        while i < len(lengths) and lengths[i] > room:
            i = bisect.bisect_left(lengths, -room, i, key=lambda x: -x)
        if i >= len(lengths) or room == 0:
            found.append((room, sum(n for _, n in chosen), chosen))
            return
        k = lengths[i]
        for n in range(min(counts[k], room // k), -1, -1):
            if n == 0 and room >= lengths[-1] and i + 1 >= len(lengths):
                continue  # dominated: a piece would still fit
            go(i + 1, room - n * k, (*chosen, (k, n)) if n else chosen)
            if len(found) >= most * 4:
                return

    go(0, room, ())
    found.sort(key=lambda x: x[:2])
    kept: list[tuple[tuple[int, int], ...]] = []
    for _, _, items in found:
        if len(kept) < most and not any(dominates(x, items) for x in kept):
            kept.append(items)
    return kept


def bin_completion(counts: dict[int, int], capacity: int, nodes: int = NODES) -> list[Pattern]:
    """As few sequences as found: best-fit decreasing, then branch and bound.

    A node completes the sequence around the largest piece left, as often as
    the counts allow; a branch ends when its waste exceeds what an improvement
    on the incumbent may have, and all end when the incumbent meets the lower
    bound. The branch's own counts are changed and changed back, so memory
    grows with its depth alone. Every so many nodes, best-fit decreasing of
    what is left makes a new incumbent.
    """
    left = {k: v for k, v in counts.items() if v}
    total = sum(k * v for k, v in left.items())
    best = best_fit(left, capacity)
    fewest = sum(n for _, n in best)
    least = max(-(-total // capacity), sum(v for k, v in left.items() if 2 * k > capacity))

    def options() -> Iterator[Pattern]:
        largest = max(left)
        left[largest] -= 1
        found = fillings(sorted((k for k, v in left.items() if v), reverse=True), left, capacity - largest)
        left[largest] += 1
        for option in found:
            items = dict(option)
            items[largest] = items.get(largest, 0) + 1
            yield tuple(sorted(items.items(), reverse=True)), min(left[k] // n for k, n in items.items())

    def change(pattern: Pattern, sign: int) -> None:
        for k, n in pattern[0]:
            v = left.get(k, 0) + sign * n * pattern[1]
            if v:
                left[k] = v
            else:
                del left[k]

    done: list[Pattern] = []
    used = waste = 0
    branch = [options()] if left else []
    while branch and fewest > least and nodes > 0:
        pattern = next(branch[-1], None)
        if pattern is None:
            branch.pop()
            if done:
                change(done[-1], 1)
                items, times = done.pop()
                used -= times
                waste -= times * (capacity - sum(k * n for k, n in items))
            continue
        nodes -= 1
        spare = pattern[1] * (capacity - sum(k * n for k, n in pattern[0]))
        if waste + spare > (fewest - 1) * capacity - total:
            continue
        change(pattern, -1)
        done.append(pattern)
        used += pattern[1]
        waste += spare
        if not left or nodes % RENEW == 0:
            rest = best_fit(left, capacity)
            if (n := used + sum(x for _, x in rest)) < fewest:
                best, fewest = [*done, *rest], n
        branch.append(options() if left else iter(()))
    return best


def layout(patterns: list[Pattern]) -> np.ndarray:
    """Where pieces go. Columns: length, first number, first sequence, pieces
    of that length in a sequence, offset of the first; ordered by the first two."""
    rows, taken, sequence = [], {}, 0
    for items, times in patterns:
        for (k, n), offset in zip(items, accumulate((k * n for k, n in items), initial=0), strict=False):
            rows.append((k, taken.get(k, 0), sequence, n, offset))
            taken[k] = taken.get(k, 0) + n * times
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, nodes: int = NODES, with_ids: bool = False) -> DataFrame:
    """Pack ``docs`` (doc_id, text). Returns one row per piece: doc_id, piece,
    start, length, ids_crc32, sequence_id, offset, and ids if ``with_ids``."""
    pieces = materialise(tokenize_pieces(docs, tokenizer_path, capacity, end_id, with_ids))
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    # At most `capacity` rows, of any corpus.
    counts = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    spots = docs.sparkSession.sparkContext.broadcast(layout(bin_completion(counts, capacity, nodes)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = per_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = pieces.join(base, ["task", "length"]).withColumn("nth", F.col("nth") + F.col("base"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in (pieces.schema[c] for c in names)) + ", sequence_id long, offset long"

    def place(batches):
        plan = spots.value
        shift = np.int64(1) << 44
        starts = plan[:, 0] * shift + plan[:, 1]
        for b in batches:
            if not b.num_rows:
                continue
            length, nth = (column(b, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "nth"))
            row = np.searchsorted(starts, length * shift + nth, "right") - 1
            done, slot = np.divmod(nth - plan[row, 1], plan[row, 3])
            yield pa.RecordBatch.from_arrays([*(column(b, c) for c in names), pa.array(plan[row, 2] + done), pa.array(plan[row, 4] + slot * length)], [*names, "sequence_id", "offset"])

    return numbered.select(*names, "nth").mapInArrow(place, schema)
