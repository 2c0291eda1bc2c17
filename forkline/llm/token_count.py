"""Token counts: byte-pair merging on a linked list with a heap of ranks; tokens are counted, never spelled out."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes

#: Fixed pattern of the byte-level pre-tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A worker remembers the counts of so many pieces of text at most, and then starts anew; it only saves time.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64


def count_after_merges(piece: bytes, ranks: dict[tuple[int, int], tuple[int, int]], first: list[int]) -> int:
    """Tokens left of `piece`: its symbols minus the merges made, always of the lowest-rank adjacent pair, leftmost first.

    ranks: (left, right) -> (rank, merged symbol); first: the symbol of each byte.
    """
    n = len(piece)
    if n < 2:
        return n
    symbol = [first[b] for b in piece]
    after = [*range(1, n), -1]
    before = [-1, *range(n - 1)]
    heap = []
    for i in range(n - 1):
        if (found := ranks.get((symbol[i], symbol[i + 1]))) is not None:
            heap.append((found[0], i, symbol[i], symbol[i + 1], found[1]))
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, a, b, merged = heapq.heappop(heap)
        j = after[i]
        if symbol[i] != a or j < 0 or symbol[j] != b:
            continue  # one of the two was merged with another neighbour
        symbol[i], symbol[j] = merged, -1
        left -= 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (found := ranks.get((merged, symbol[k]))) is not None:
                heapq.heappush(heap, (found[0], i, merged, symbol[k], found[1]))
        if (h := before[i]) >= 0 and (found := ranks.get((symbol[h], merged))) is not None:
            heapq.heappush(heap, (found[0], h, symbol[h], merged, found[1]))
    return left


def byte_alphabet() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte: itself if it is visible, else the next from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def read_vocabulary(path: str) -> str:
    """What counting needs of a byte-level BPE vocabulary (.json), a file beside the driver."""
    with open(path, encoding="utf-8") as file:
        read = json.load(file)
    return json.dumps({"model": {k: read["model"][k] for k in ("vocab", "merges")}, "added_tokens": read.get("added_tokens")})


class Counter(dict):
    """Counts the tokens of texts; as a dict it holds the counts of pieces seen before."""

    def __init__(self, vocabulary: dict):
        super().__init__()
        ids = vocabulary["model"]["vocab"]
        self.ranks = {}
        for rank, pair in enumerate(vocabulary["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault((ids[a], ids[b]), (rank, ids[a + b]))
        self.first = [ids[c] for c, _ in sorted(byte_alphabet().items(), key=lambda x: x[1])]
        special = sorted((t["content"] for t in vocabulary.get("added_tokens") or ()), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = count_after_merges(piece.encode(), self.ranks, self.first)
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n

    def count(self, text: str) -> int:
        parts = self.special.split(text) if self.special else [text]
        return len(parts) - 1 + sum(sum(map(self.__getitem__, self.pieces(part))) for part in parts)


@lru_cache(maxsize=1)
def _counter(vocabulary: str) -> Counter:
    return Counter(json.loads(vocabulary))


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit): one row for each row of `docs` (doc_id, text, ...), without a shuffle.

    Counts are those of the byte-level BPE vocabulary at `vocabulary_path`, without begin or end tokens; its special
    strings inside a text count as one token each. A null text is empty (0 tokens); a null doc_id stays null.
    The vocabulary is a fixed file of a few MB, sent to the executors once as a broadcast variable.
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.count(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes())
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

