"""Cost-balanced packing of tokenised documents into sequences of a fixed token capacity.

Each document is tokenised whole, an end id is appended, and its tokens are cut into pieces that fill sequences
exactly. A sequence costs ``linear * tokens + quadratic * sum(piece ** 2)``: attention stays within a piece, so its
cost grows with the square of each piece. Whole capacities are cut off first (nothing can share such a sequence);
what is left of each document is placed in descending order, each on the lowest-cost sequence that still has room
for it. A rest that fits nowhere whole is cut at the roomiest sequence.

One pass, no shuffle: every task packs what it reads, in blocks of a bounded number of tokens, so memory doesn't
depend on the size of the input or of a partition. The last tokens of a block, fewer than a capacity, go to
sequences whose capacities are powers of two, which need no padding.

Defined cases: a null or empty text is the end id alone; repeated rows and repeated ids are packed each for itself; an
empty table gives no rows; a null doc_id stays null; ties go to the sequence that was opened first; extra columns are
ignored. Sequence ids are unique over the whole result: they hold the number of the task's partition.
"""

from __future__ import annotations

import base64
import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 1024
BLOCK_TOKENS = 4_000_000
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


class Encoder:
    """Ids of the public byte-level vocabulary. tiktoken gives the ids of the tokenizers file about five times faster;
    a text that holds a special token's string goes to tokenizers, which reads it as that token."""

    def __init__(self, json_path: str | None = None, ranks_path: str | None = None):
        import public_tokenizers
        import tiktoken

        self.json_path = json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = None

    def __call__(self, text: str) -> np.ndarray:
        if "<|endoftext|>" in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.json_path)
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return np.array([*ids, END_ID], dtype="<u4")


class Sequences:
    """Open sequences, found by room and cost: a tree over the free room holds, for each room, a heap by cost."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.heaps: list[list] = [[] for _ in range(self.leaves)]
        self.low = [(float("inf"), -1)] * (2 * self.leaves)
        self.room: dict[int, int] = {}

    def _fix(self, room: int) -> None:
        at, heap = room + self.leaves, self.heaps[room]
        self.low[at] = heap[0] if heap else (float("inf"), -1)
        while at > 1:
            at //= 2
            self.low[at] = min(self.low[2 * at], self.low[2 * at + 1])

    def add(self, room: int, cost: float, number: int) -> None:
        heapq.heappush(self.heaps[room], (cost, number))
        self.room[number] = room
        self._fix(room)

    def take(self, least: int) -> tuple[int, float, int]:
        """Removes the lowest-cost sequence with that much room, or else the roomiest one."""
        best, a, b = (float("inf"), -1), least + self.leaves, 2 * self.leaves
        while a < b:
            if a & 1:
                best, a = min(best, self.low[a]), a + 1
            if b & 1:
                b -= 1
                best = min(best, self.low[b])
            a, b = a // 2, b // 2
        if best[1] < 0:
            at = 1
            while at < self.leaves:
                at = 2 * at + (self.low[2 * at + 1][1] >= 0)
            room = at - self.leaves
        else:
            room = self.room[best[1]]
        cost, number = heapq.heappop(self.heaps[room])
        self._fix(room)
        return room, cost, number


def pack_block(lengths: list[int], capacity: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], list[float]]:
    """Pieces (document, start, length, sequence, offset) of documents of these lengths, and the cost of each sequence."""
    cost_of = lambda n: linear * n + quadratic * n * n
    pieces, costs, rests = [], [], []
    for k, n in enumerate(lengths):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((k, start, capacity, len(costs), 0))
            costs.append(cost_of(capacity))
        if n % capacity:
            rests.append((n % capacity, k, n - n % capacity))
    rooms, over = divmod(sum(n for n, _, _ in rests), capacity)
    sizes = [capacity] * rooms + [1 << i for i in reversed(range(over.bit_length())) if over >> i & 1]
    open_, full = Sequences(capacity), dict(enumerate(sizes, len(costs)))
    for number, room in full.items():
        open_.add(room, 0.0, number)
    costs += [0.0] * len(sizes)
    for n, k, start in sorted(rests, key=lambda x: (-x[0], x[1])):
        while n:
            room, cost, number = open_.take(n)
            m = min(n, room)
            pieces.append((k, start, m, number, full[number] - room))
            costs[number] = cost = cost + cost_of(m)
            if room > m:
                open_.add(room - m, cost, number)
            n, start = n - m, start + m
    return pieces, costs


def pack(df: DataFrame, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC, block_tokens: int = BLOCK_TOKENS, json_path: str | None = None, ranks_path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; with_ids adds the piece's token ids."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = Encoder(json_path, ranks_path)
        base = TaskContext.get().partitionId() << 40
        keys: list = []
        ids: list[np.ndarray] = []
        held = done = 0

        def flush() -> pd.DataFrame:
            nonlocal held, done
            pieces, costs = pack_block([len(x) for x in ids], capacity, linear, quadratic)
            k, start, length, number, offset = (np.array(x, dtype=np.int64) for x in zip(*pieces, strict=True))
            parts = [ids[i][s : s + n] for i, s, n, _, _ in pieces]
            out = pd.DataFrame({"doc_id": pd.array([keys[i] for i in k], dtype="Int64"), "start": start, "length": length, "ids_crc32": [zlib.crc32(x.tobytes()) for x in parts], "doc_tokens": [len(ids[i]) for i in k], "sequence_id": base + done + number, "offset": offset, "cost": np.array(costs)[number]})
            if with_ids:
                out["ids"] = [x.astype(np.int32) for x in parts]
            done += len(costs)
            keys.clear()
            ids.clear()
            held = 0
            return out

        for batch in batches:
            for key, text in zip(batch["doc_id"], batch["text"], strict=True):
                keys.append(None if pd.isna(key) else int(key))
                ids.append(encode(text if isinstance(text, str) else ""))
                held += len(ids[-1])
                if held >= block_tokens:
                    yield flush()
        if ids:
            yield flush()

    rows = df.selectExpr("cast(doc_id as long) as doc_id", "text")
    return rows.mapInPandas(run, SCHEMA + (", ids array<int>" if with_ids else ""))
