"""Packing into sequences by a dot-product heuristic under three limits.

A sequence holds at most ``max_tokens`` tokens, ``max_segments`` pieces and
``max_loss`` tokens that bear loss.  Within a group of examples an open sequence
takes, of those that fit, the example whose size has the largest dot product with
what is left of the three limits (each as a part of its limit).  Where none fits,
an example is cut to fill the sequence; one longer than a sequence gives whole
sequences first.  A sequence that a limit or the end of the group leaves short is
cut down to a power of two, so no padding is left.

Examples are packed where they are read, in groups of at most ``group`` rows and
``group_tokens`` tokens (or one longer example): no shuffle, no key, and bounded
memory.  Sequence numbers hold the task's partition, so they are unique.

Defined cases: null text is empty and consists of the closing id; repeated rows are
examples of their own; of equal examples the one read first is taken first; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from posolog.llm.common import text_or_empty
from posolog.llm.token_counts import Memory, byte_values, merger

MAX_TOKENS = 4096
MAX_SEGMENTS = 256
MAX_LOSS = 4096
GROUP = 2048
GROUP_TOKENS = 4_000_000
CLOSING_ID = 2

# The vocabulary's pre-token pattern and mark of a word's end.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
END = "</w>"


class WordIds:
    """Ids of a text, little-endian 32-bit, for a vocabulary whose words end at white space.

    A stretch between white space has the same ids alone as in its text, so each is
    encoded once.  Its pre-tokens are merged by rank with a byte after the last one
    that stands for the end of a word (0xFF, which no UTF-8 text holds).  Stretches
    with characters from U+0300 on, and texts with an added token's string or one of
    the four separators that only Python takes for white space, go to the library.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        added = {token["content"] for token in rules["added_tokens"]}
        self.whole = re.compile("|".join([*map(re.escape, added), "[\x1c-\x1f]"]))
        self.pattern = regex.compile(PATTERN)
        value = byte_values()
        self.ranks = {}
        for token, token_id in rules["model"]["vocab"].items():
            if token not in added:
                end = token.endswith(END)
                body = bytes(map(value.__getitem__, token.removesuffix(END) if end else token))
                self.ranks[body + b"\xff" * end] = token_id
        self.merge = merger(self.ranks)
        self.words = Memory(self.word)

    def by_library(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, word: str) -> bytes:
        if not word.isascii() and max(word) >= "\u0300":
            return self.by_library(word)
        low = unicodedata.normalize("NFC", word).lower()
        if low[-1] in ".," and low[:-1].isalpha():
            return self.words[low[:-1]] + self.words[low[-1]]
        tokens = [low] if low.isalpha() else self.pattern.findall(low)
        ids: list[int] = []
        for token in tokens:
            body = token.encode() + b"\xff"
            if body in self.ranks and len(token) > 1:  # a word of the vocabulary: as the library merges it
                return self.by_library(word)
            ids += self.merge(body)
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: str) -> bytes:
        if self.whole.search(text):
            return self.by_library(text)
        return b"".join(map(self.words.__getitem__, (text.lower() if text.isascii() else text).split()))


@functools.cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pack(tokens: list[int], loss: list[int], max_tokens: int, max_segments: int, max_loss: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (example, start, length); ``loss`` counts an example's first tokens.

    Sequences have ``max_tokens`` tokens or a power of two.
    """
    limits = np.array([max_tokens, max_segments, max_loss], float)
    start = np.zeros(len(tokens), np.int64)
    size = np.array(tokens, np.int64)
    bears = np.minimum(np.array(loss, np.int64), size)
    order = np.flatnonzero(size > 0)

    def cut(i: int, length: int) -> tuple[int, int, int]:
        piece = (int(i), int(start[i]), int(length))
        start[i] += length
        size[i] -= length
        bears[i] = max(0, bears[i] - length)
        return piece

    # Whole sequences of long examples, as many tokens as bear loss within the limit.
    most = min(max_tokens, max_loss)
    most = max_tokens if max_loss >= max_tokens else 1 << (most.bit_length() - 1)
    for i in order:
        while size[i] >= most:
            yield [cut(i, most)]
    left = order[size[order] > 0]
    while len(left):
        free = limits.copy()
        pieces: list[tuple[int, int, int]] = []
        taken = np.zeros(len(left), bool)
        sizes = np.stack([size[left], np.ones(len(left)), bears[left]], 1)
        weighed = sizes / limits
        while free[0] >= 1 and free[1] >= 1:
            score = np.where(taken | (sizes > free).any(1), -1.0, weighed @ (free / limits))
            best = int(np.argmax(score)) if len(score) else 0
            if score[best] < 0:
                break
            i = left[best]
            pieces.append(cut(i, size[i]))
            taken[best] = True
            free -= sizes[best]
        if free[0] >= 1 and free[1] >= 1 and not taken.all():
            # The smallest example that is left has more tokens than are free: cut it.
            i = left[int(np.argmin(np.where(taken, np.inf, sizes[:, 0])))]
            room = int(min(free[0], size[i] if bears[i] <= free[2] else free[2]))
            if room > 0:
                pieces.append(cut(i, room))
        used = sum(length for _, _, length in pieces)
        surplus = 0 if used == max_tokens else used - (1 << (used.bit_length() - 1))
        while surplus:  # give back from the end, down to a power of two
            i, begin, length = pieces.pop()
            back = min(surplus, length)
            start[i] -= back
            size[i] += back
            bears[i] = max(0, min(loss[i] - int(start[i]), int(size[i])))
            surplus -= back
            if back < length:
                pieces.append((i, begin, length - back))
        yield pieces
        left = left[size[left] > 0]


def packed(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    loss_col: str | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int = MAX_LOSS,
    group: int = GROUP,
    group_tokens: int = GROUP_TOKENS,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``loss_col`` gives the number of first tokens of an example that bear loss
    (all, if there is no such column or it is null).
    """
    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("text"),
        (F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")).alias("loss"),
    )
    id_type = rows.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        number = TaskContext.get().partitionId() << 40
        held: list[tuple[object, bytes, int]] = []
        weight = 0

        def close() -> pa.RecordBatch:
            nonlocal number
            tokens = [len(ids) // 4 for _, ids, _ in held]
            out: list[tuple] = []
            for pieces in pack(tokens, [loss for _, _, loss in held], max_tokens, max_segments, max_loss):
                offset = 0
                for i, start, length in pieces:
                    view = memoryview(held[i][1])[4 * start : 4 * (start + length)]
                    out.append((held[i][0], start, length, zlib.crc32(view), tokens[i], number, offset))
                    offset += length
                number += 1
            arrays = [pa.array(values, None if name == "doc_id" else pa.int64()) for name, values in zip(columns, zip(*out, strict=True), strict=True)]
            return pa.RecordBatch.from_arrays(arrays, columns)

        for batch in batches:
            for key, body, loss in zip(batch.column("doc_id"), batch.column("text"), batch.column("loss"), strict=True):
                ids = encode(body.as_py()) + closing
                n = len(ids) // 4
                if held and (len(held) >= group or weight + n > group_tokens):
                    yield close()
                    held, weight = [], 0
                held.append((key.as_py(), ids, n if loss.as_py() is None else min(n, max(0, loss.as_py()))))
                weight += n
        if held:
            yield close()

    schema = f"doc_id {id_type}, " + ", ".join(f"{c} long" for c in columns[1:])
    return rows.mapInArrow(run, schema)
