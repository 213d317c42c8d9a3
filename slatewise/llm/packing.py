"""Packing documents into fixed windows by minimum bin slack.

Each task reads its part of the documents once: it tokenizes them, cuts whole
windows off long documents, and keeps the rests in a multiset by length. A window
takes the longest rest and then the multiset of other rests that comes closest to
its capacity, found by a subset sum over one bitset and read off backwards as
counts per length. Where the closest multiset leaves slack, one rest is cut to
fill it, so windows are full. What is left at the end of a task, less than one
window, becomes sequences whose lengths are powers of two, which need no padding.
There is no shuffle, and a lost task repeats to the same sequences.

Defined cases: a NULL or empty text is the end id alone; repeated rows are
documents of their own; an empty table gives an empty result; a NULL doc_id is
kept; columns besides `doc_id` and `text` are not read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 2048
END_ID = 1
#: Tokens gathered before windows are filled, and rows put out at once.
WINDOW_TOKENS, ROWS = 1 << 20, 4096
#: Fixed value: how byte-level models cut text into words.
BYTE_LEVEL_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The ranks' reader steps back over white space one by one and breaks off above 1,000,000; texts with such a run are read by the library.
LONG_BLANKS = 100_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts as little-endian 32-bit bytes.

    A byte-level BPE whose merges are numbered in their order is the same model as
    a table of ranks, which is read several times faster; any other model file is
    used as it is, and so is this one for texts with `LONG_BLANKS` blanks in a row.
    The ids are those of the model file in all cases.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.whole, self.blanks = path, None, re.compile(r"\s{%d}" % LONG_BLANKS)
        with open(path, encoding="utf-8") as f:
            parts = json.load(f)
        self.special = {t["content"]: t["id"] for t in parts.get("added_tokens", [])}
        ranks = self._ranks(parts)
        if ranks:
            import tiktoken

            self.model = tiktoken.Encoding("ranks", pat_str=BYTE_LEVEL_WORDS, mergeable_ranks=ranks, special_tokens=self.special)
            self._ids = self._ranked
        else:
            self._ids = self._library

    def _ranks(self, parts) -> dict[bytes, int] | None:
        """Ids by bytes, if the file is a plain byte-level model with its merges in order of their ids."""
        model, before = parts["model"], parts.get("pre_tokenizer") or {}
        plain = (model["type"] == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
                 and not before.get("add_prefix_space") and not parts.get("normalizer") and not model.get("byte_fallback")
                 and not model.get("dropout") and not model.get("ignore_merges"))
        if not plain:
            return None
        letter = {c: b for b, c in _byte_letters().items()}
        ids = {t: i for t, i in model["vocab"].items() if t not in self.special}
        merged = [ids.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        ordered = None not in merged and all(x < y for x, y in zip(merged, merged[1:])) and len(merged) + 256 == len(ids)
        return {bytes(letter[c] for c in t): i for t, i in ids.items()} if ordered else None

    def _library(self, text: str):
        """By the tokenizer library, loaded with the first text that needs it."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return self.whole.encode(text, add_special_tokens=False).ids

    def _ranked(self, text: str):
        if len(text) >= LONG_BLANKS and self.blanks.search(text):
            return self._library(text)
        if any(s in text for s in self.special):
            return self.model.encode(text, allowed_special="all")
        return self.model.encode_ordinary(text)

    def __call__(self, text: str) -> bytes:
        return np.array(self._ids(text), "<u4").tobytes()


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


def closest(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """How many of each length to take for the largest sum up to capacity; counts: how many there are."""
    reach, steps, full = 1, [], 1 << capacity
    mask = (full << 1) - 1
    for length in sorted((x for x in counts if 0 < x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left and not reach & full:
            k = min(k, left)
            steps.append((length, k, reach))
            reach |= reach << (length * k) & mask
            left, k = left - k, k * 2
        if reach & full:
            break
    total, taken = reach.bit_length() - 1, defaultdict(int)
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            taken[length] += k
            total -= length * k
    return dict(taken)


class Rests:
    """Pieces by length; windows are filled from them."""

    def __init__(self, capacity: int):
        self.capacity, self.by_length, self.total = capacity, {}, 0

    def add(self, piece) -> None:
        self.by_length.setdefault(piece[2], []).append(piece)
        self.total += piece[2]

    def take(self, length: int):
        stack = self.by_length[length]
        piece = stack.pop()
        if not stack:
            del self.by_length[length]
        self.total -= length
        return piece

    def window(self) -> list:
        """Pieces that fill one window; needs as many tokens as it holds."""
        out = [self.take(max(self.by_length))]
        room = self.capacity - out[0][2]
        for length, n in closest({k: len(v) for k, v in self.by_length.items()}, room).items():
            out += [self.take(length) for _ in range(n)]
            room -= n * length
        if room:
            doc, start, length = self.take(max(self.by_length))
            out.append((doc, start, room))
            self.add((doc, start + room, length - room))
        return out

    def powers(self) -> list[list]:
        """All that is left, in sequences whose lengths are powers of two, longest first."""
        pieces = [self.take(max(self.by_length)) for _ in range(sum(map(len, self.by_length.values())))]
        out, left = [], sum(p[2] for p in pieces)
        while left:
            room = size = 1 << left.bit_length() - 1
            out.append([])
            while room:
                doc, start, length = pieces.pop(0)
                out[-1].append((doc, start, used := min(length, room)))
                if used < length:
                    pieces.insert(0, (doc, start + used, length - used))
                room -= used
            left -= size
        return out


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID,
         with_ids: bool = False) -> DataFrame:
    """One row per piece of a document (`SCHEMA`); with `with_ids` also its token ids as an array."""
    path = tokenizer or default_tokenizer()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode, rests, owners = Encoder(path), Rests(capacity), {}
        first = TaskContext.get().partitionId() << 40
        made, rows, serial, gathered = 0, defaultdict(list), 0, 0

        def emit(pieces):
            nonlocal made
            at = 0
            for doc, start, length in pieces:
                doc_id, ids = owners[doc]
                part = ids[4 * start : 4 * (start + length)]
                for name, value in (("doc_id", doc_id), ("start", start), ("length", length),
                                    ("ids_crc32", zlib.crc32(part)), ("doc_tokens", len(ids) // 4),
                                    ("sequence_id", first + made), ("offset", at)):
                    rows[name].append(value)
                if with_ids:
                    rows["ids"].append(np.frombuffer(part, "<u4").astype("i4"))
                at += length
            made += 1

        def flush():
            table = pa.table({k: pa.array(v, pa.list_(pa.int32()) if k == "ids" else pa.int64()) for k, v in rows.items()})
            rows.clear()
            return table.combine_chunks().to_batches()

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encode(text.as_py() or "")
                serial += 1
                owners[serial] = (doc_id, ids + end)
                n = len(ids) // 4 + 1
                for start in range(0, n - capacity + 1, capacity):
                    emit([(serial, start, capacity)])
                if n % capacity:
                    rests.add((serial, n - n % capacity, n % capacity))
                else:
                    del owners[serial]
                gathered += n
                if gathered >= WINDOW_TOKENS:
                    while rests.total >= capacity:
                        emit(rests.window())
                    kept = {p[0] for stack in rests.by_length.values() for p in stack}
                    owners, gathered = {k: owners[k] for k in kept}, 0
                if rows and len(rows["doc_id"]) >= ROWS:
                    yield from flush()
        while rests.total >= capacity:
            emit(rests.window())
        for pieces in rests.powers():
            emit(pieces)
        if rows:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(
        run, SCHEMA + (", ids array<int>" if with_ids else ""))
