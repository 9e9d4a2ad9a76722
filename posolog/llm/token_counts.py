"""Token counts of whole texts under a byte-level BPE vocabulary.

Whole-token shortcut: a vocabulary string that the pre-tokeniser leaves whole and
that encodes alone as its own id is one token wherever it occurs as a pre-token.
The set of these is proved once for a vocabulary, before any text is read; a
pre-token in it counts 1, and only the others are merged (each distinct one once
for a worker's memory).

Texts are cut before every single space first; no pre-token crosses such a cut
unless spaces meet, and a text where they do is pre-tokenised whole.  The pattern's
character classes are known to agree with the library's on ``SAME_CLASSES``; a piece
with any other character, and a text that holds an added token's string, is encoded
by the library as it is.

Defined cases: null counts as empty (0 bytes, 0 tokens); rows that repeat a
``doc_id`` are counted each; an empty table gives an empty result; only the two
named columns are read.  A text is one row of a batch, whatever its length.
"""

from __future__ import annotations

import contextlib
import functools
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from posolog.llm.common import text_or_empty

OVER_LIMIT = 512
#: Distinct pieces that a worker remembers; beyond them it starts anew.
REMEMBERED = 1_000_000

# The vocabulary's pre-token pattern, and code points whose classes
# (letter, number, space, other) the tests compare with the library's.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SAME_CLASSES = ((0x0, 0x52F), (0x900, 0xBFF), (0x2010, 0x205E), (0x3000, 0x9FFF), (0xAC00, 0xD7A3))


def byte_values() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary, and the byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [byte for byte in range(256) if byte not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


def merger(ranks: dict[bytes, int]):
    """Merges one pre-token's bytes, the lowest rank first."""
    import tiktoken

    return tiktoken.Encoding("ranks", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Memory(dict):
    """Remembers results for short keys, a bounded number of them."""

    def __init__(self, of) -> None:
        self.of = of

    def __missing__(self, key):
        value = self.of(key)
        if len(key) <= 64:
            if len(self) >= REMEMBERED:
                self.clear()
            self[key] = value
        return value


class Counter:
    """Counts tokens as the library does, from the vocabulary file's own rules."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in rules["added_tokens"]) or "(?!)")
        #: A space before white space, or at the end, is no place to cut.
        self.meeting = re.compile(r" \s| $")
        self.pattern = regex.compile(PATTERN)
        self.known = regex.compile("[" + "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in SAME_CLASSES) + "]*+")
        value = byte_values()
        ranks = {bytes(map(value.__getitem__, t)): i for t, i in rules["model"]["vocab"].items()}
        merged = [ranks[bytes(map(value.__getitem__, "".join(pair)))] for pair in rules["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError(f"the ids of {path} are not in the order of its merges")
        self.merge = merger(ranks)
        self.whole, self.odd = self.whole_tokens(ranks)
        self.pieces = Memory(self.piece)
        self.spaced = Memory(lambda rest: self.piece(" " + rest))

    def whole_tokens(self, ranks: dict[bytes, int]) -> tuple[frozenset[str], frozenset[str]]:
        """Vocabulary strings that are one pre-token: those that the library encodes
        as their own id, and those that it does not (they need its own merges)."""
        strings = {}
        for token, token_id in ranks.items():
            with contextlib.suppress(UnicodeDecodeError):
                string = token.decode()
                if self.pattern.findall(string) == [string]:
                    strings[string] = token_id
        encoded = self.library.encode_batch_fast(list(strings), add_special_tokens=False)
        whole = {s for (s, i), e in zip(strings.items(), encoded, strict=True) if e.ids == [i]}
        return frozenset(whole), frozenset(strings) - whole

    def by_library(self, text: str) -> int:
        return len(self.library.encode(text, add_special_tokens=False).ids)

    def pretoken(self, token: str) -> int:
        if token in self.whole:
            return 1
        return self.by_library(token) if token in self.odd else len(self.merge(token.encode()))

    def piece(self, text: str) -> int:
        """Tokens of a stretch that the cuts around it leave unchanged."""
        if not self.known.fullmatch(text):
            return self.by_library(text)
        return sum(map(self.pretoken, self.pattern.findall(text)))

    def __call__(self, text: str) -> int:
        if self.added.search(text):
            return self.by_library(text)
        if self.meeting.search(text):
            return self.piece(text)
        first, *rest = text.split(" ")
        return self.pieces[first] + sum(map(self.spaced.__getitem__, rest))


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = OVER_LIMIT
) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row, no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter(path)
        for batch in batches:
            counts = [tokens(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    text = text_or_empty(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    )
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_tokens long"
    return rows.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
