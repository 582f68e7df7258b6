"""Cost-balanced packing of tokenised documents into training sequences.

The cost of a piece of n tokens is estimated as n + n * n / max_tokens: a linear part
and the quadratic part of attention within the piece. Documents are cut into full
sequences and a rest. The rests of a buffer are taken in descending length and each
goes to the sequence of lowest cost whose remaining tokens hold it; if none does, it
is cut over the sequences of lowest cost. A buffer opens just the sequences that its
tokens fill: full ones, and for the last tokens one of each power of two, so that none
needs padding.

Buffers are bounded stretches of one input partition; nothing is shuffled. Sequence
ids hold the partition and a running number, so a task that runs again on the same
rows gives the same rows. The input must therefore give each partition the same rows
in the same order when read again, as a table scan does.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from newsprism.llm.common import pick, worker_state

MAX_TOKENS = 2048
END_ID = 1
#: Tokens of rests that one buffer gathers before it is packed.
BUFFER_TOKENS = 1 << 20
#: Words whose ids one Python worker remembers; beyond it the memory starts anew.
REMEMBERED = 800_000
#: New words are tokenised so many at a time, parted by a word of a single token.
GROUP, PARTING = 64, "\x01"
#: What every special token's string holds: such texts go to the tokenizer whole.
SPECIAL = "<|"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
DDL = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Ids of whole texts by a tokenizer whose words never span white space, as its plain call gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        parting = self._ids([PARTING])[0]
        self.parting = parting[0] if len(parting) == 1 else None

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words: tokenised in groups, whose ids are cut where the parting token stands."""
        plain = [w for w in words if PARTING not in w and self.parting is not None]
        alone = [w for w in words if PARTING in w or self.parting is None]
        groups = [plain[i:i + GROUP] for i in range(0, len(plain), GROUP)]
        for group, ids in zip(groups, self._ids([f" {PARTING} ".join(g) for g in groups])):
            packed = np.array(ids, dtype="<u4")
            cuts = np.flatnonzero(packed == self.parting)
            if len(cuts) != len(group) - 1:
                alone += group
                continue
            begin, data = 0, packed.tobytes()
            for word, end in zip(group, [*(4 * cuts).tolist(), len(data)]):
                self.known[word] = data[begin:end]
                begin = end + 4
        for word, ids in zip(alone, self._ids(alone)):
            self.known[word] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        # \x1c-\x1f split in Python but not in the tokenizer, special tokens may hold any part of a text: whole texts
        split = [None if SPECIAL in t or any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        new = {w for words in split if words for w in words if w not in known}
        if new:
            new = list(new)
            for i in range(0, len(new), 50_000):
                self._learn(new[i:i + 50_000])
        return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()
                if words is None else b"".join(map(known.__getitem__, words))
                for t, words in zip(texts, split)]


def _tokens(path: str) -> WordTokens:
    """The worker's tokenizer: later tasks of the same worker find its words."""
    return worker_state(("packing", path), lambda: WordTokens(path))


def piece_cost(length, max_tokens: int = MAX_TOKENS):
    """Estimated cost of attending within a piece: linear plus quadratic."""
    return length + length * length / max_tokens


def open_sequences(tokens: int, max_tokens: int) -> np.ndarray:
    """Capacities that hold ``tokens`` exactly: full sequences, then descending powers of two."""
    rest = tokens % max_tokens
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.array([max_tokens] * (tokens // max_tokens) + powers, dtype=np.int64)


def balance(lengths: list[int], max_tokens: int = MAX_TOKENS) -> list[tuple[int, int, int, int]]:
    """(item, start within the item, length, sequence) for rests of up to ``max_tokens`` tokens.

    Descending length, ties to the earlier item; lowest cost first, ties to the earlier sequence.
    """
    room = open_sequences(sum(lengths), max_tokens)
    cost = np.zeros(len(room))
    placed = []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        start, left = 0, lengths[item]
        while left:
            fits = room >= left
            if not fits.any():
                fits = room > 0
            at = int(np.argmin(np.where(fits, cost, np.inf)))
            size = min(left, int(room[at]))
            placed.append((item, start, size, at))
            room[at] -= size
            cost[at] += piece_cost(size, max_tokens)
            start, left = start + size, left - size
    return placed


def _pack(rests: list[tuple], full: list[tuple], first: int, max_tokens: int) -> tuple[pa.RecordBatch, int]:
    """Rows of one buffer. rests and full hold (doc_id, start, ids as bytes, tokens of the document)."""
    out = [(doc, start, len(ids) // 4, ids, total, first + n, 0) for n, (doc, start, ids, total) in enumerate(full)]
    first += len(full)
    used: dict[int, int] = {}
    for item, start, size, at in balance([len(r[2]) // 4 for r in rests], max_tokens):
        doc, begin, ids, total = rests[item]
        offset = used.get(at, 0)
        out.append((doc, begin + start, size, ids[4 * start:4 * (start + size)], total, first + at, offset))
        used[at] = offset + size
    columns = [pa.array(list(c), f.type) for c, f in zip(zip(*out), SCHEMA)]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA), first + len(used)


def pack_documents(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                   max_tokens: int = MAX_TOKENS, end_id: int = END_ID,
                   buffer_tokens: int = BUFFER_TOKENS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (packed), doc_tokens, sequence_id, offset.

    A document is its tokens and ``end_id``; null and empty texts are just that id.
    ``max_tokens`` is a power of two. Every id lies in exactly one piece. Repeated
    rows are packed each; a null doc_id stays null; an empty table gives no pieces.
    """
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    end = np.array([end_id], dtype="<u4").tobytes()
    width = 4 * max_tokens

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(tokenizer_path)
        base = TaskContext.get().partitionId() << 33
        rests, full, waiting, first = [], [], 0, base
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for lo in range(0, len(texts), 256):
                for doc, packed in zip(ids_of[lo:lo + 256], tokens.encode(texts[lo:lo + 256])):
                    packed += end
                    total, cut = len(packed) // 4, len(packed) // width * width
                    full += [(doc, at // 4, packed[at:at + width], total) for at in range(0, cut, width)]
                    if cut < len(packed):
                        rests.append((doc, cut // 4, packed[cut:], total))
                    waiting += total
                    if waiting >= buffer_tokens:
                        frame, first = _pack(rests, full, first, max_tokens)
                        yield frame
                        rests, full, waiting = [], [], 0
        if rests or full:
            yield _pack(rests, full, first, max_tokens)[0]

    rows = pick(df, doc_id=id_col, text=text_col).selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return rows.mapInArrow(pack, DDL)
