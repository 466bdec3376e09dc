"""Packing of tokenised documents into fixed windows by best-fit decreasing.

A document is its token ids and a closing id. Documents longer than a window are first cut into full windows; what remains
of each document is placed, longest first, into the open window with the least sufficient room, which a segment tree over
remaining capacities finds. Pieces are dealt by a hash of what they are into shards of bounded size, and each shard is packed
on its own: a shard leaves at most a few windows partly empty, so padding per shard is constant and falls with the input. The
same rows give the same sequences, however they lie in files and partitions.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, row_key, written

WINDOW = 4096
END_ID = 2
#: Pieces in a shard, about. Bounds a task's memory.
SHARD_PIECES = 20_000
#: Words whose ids a Python worker remembers.
CACHED_WORDS = 300_000

PIECES = "doc_id long, key struct<a:long,b:long>, start long, length long, ids_crc32 long, doc_tokens long"
#: Words as the tokenizer's pattern cuts lower-case Latin-1 text.
_LETTERS, _NUMBERS, _SPACES = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", " \t-\r\x85\xa0"
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_SPACES}{_LETTERS}{_NUMBERS}]+")
# The settings under which the words above and the bytes below are what a tokenizer makes of Latin-1 text.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_LETTERS = {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_PRINTABLE}))}


class Words(dict):
    """Ids of a word, from the tokenizer's model; remembered."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> bytes:
        text = word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        ids = self[word] = array("I", [t.id for t in self.model.tokenize(text)]).tobytes()
        return ids


def _is_latin(text: str) -> bool:
    try:
        return text.isascii() or bool(text.encode("latin-1"))
    except UnicodeEncodeError:
        return False


class WordIds:
    """Token ids of texts.

    Where the tokenizer's file says that it folds case and cuts words by the pattern above, Latin-1 text, which has no forms to
    compose, is folded and cut here, and each distinct word goes through the tokenizer's model once. Any other text, text
    that may hold a special token, and every text of any other tokenizer goes through the tokenizer whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = Words(self.tokenizer.model)
        told = json.loads(self.tokenizer.to_str())
        own_words = {"type": "Sequence", "pretokenizers": [_SPLIT, _BYTE_LEVEL]}
        self.by_words = told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == own_words and all(t["content"].startswith("<|") for t in told["added_tokens"])

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        out = []
        for text in texts:
            if self.by_words and _is_latin(text) and "<|" not in text:
                out.append(b"".join(map(self.words.__getitem__, _WORD.findall(text.lower()))))
            else:
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
        return out


_workers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


class _Cut:
    def __init__(self, tokenizer: str, window: int):
        self.tokenizer, self.window = tokenizer, window

    def __call__(self, batch) -> dict:
        end = END_ID.to_bytes(4, "little")
        ids, keys = batch.column("doc_id").to_pylist(), batch.column("key").to_pylist()
        encoded = word_ids(self.tokenizer)([t or "" for t in batch.column("text").to_pylist()])
        out = {k: [] for k in ("doc_id", "key", "start", "length", "ids_crc32", "doc_tokens")}
        for doc, key, data in zip(ids, keys, encoded, strict=True):
            data += end
            n = len(data) // 4
            for at in range(0, n, self.window):
                part = data[4 * at : 4 * (at + self.window)]
                for k, v in zip(out, (doc, key, at, len(part) // 4, zlib.crc32(part), n), strict=True):
                    out[k].append(v)
        return out


def cut(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Pieces of at most ``window`` ids: full windows first, then the rest. Texts are read once and don't leave their task."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.withColumn("key", row_key(F.col("doc_id"), F.col("text")))
    return map_arrow(rows, _Cut(tokenizer, window), PIECES)


class Rooms:
    """A segment tree over remaining capacities: which capacities some open window has."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.tree = [0] * (2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, room: int, index: int) -> None:
        self.open[room].append(index)
        at = room + self.size
        while at:
            self.tree[at] += 1
            at >>= 1

    def tightest(self, need: int) -> int | None:
        """Takes out the open window with the least room of ``need`` or more; gives its index."""
        tree, at = self.tree, need + self.size
        while not tree[at]:
            while at & 1:  # up while a right child
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.size:
            at = 2 * at if tree[2 * at] else 2 * at + 1
        room, up = at - self.size, at
        while up:
            tree[up] -= 1
            up >>= 1
        return self.open[room].pop()


def best_fit_decreasing(lengths: list[int], window: int = WINDOW) -> tuple[list[int], list[int]]:
    """The window index and the offset of each length; equal lengths in the order given."""
    rooms, used, where, offset = Rooms(window), [], [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        w = rooms.tightest(n) if n < window else None
        if w is None:
            w = len(used)
            used.append(0)
        where[i], offset[i] = w, used[w]
        used[w] += n
        if used[w] < window:
            rooms.add(window - used[w], w)
    return where, offset


def _pack_shard(window: int):
    def pack(pdf):
        pdf = pdf.loc[pdf.index.repeat(pdf["copies"])].reset_index(drop=True)
        pdf = pdf.sort_values(["length", "a", "b", "start"], ascending=[False, True, True, True], kind="stable")
        where, offset = best_fit_decreasing(pdf["length"].tolist(), window)
        pdf["sequence_id"] = pdf["shard"].to_numpy() * (1 << 32) + where
        pdf["offset"] = offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return pack


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Every id of every document in one piece; pieces in sequences of ``window`` ids at most.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A null or empty text is its closing id alone; a
    null doc_id stays null; rows that repeat one another are packed one by one; an empty table gives no rows; other columns
    are ignored. A document of any length is cut, so none is refused.
    """
    alike = ["doc_id", "key.a", "key.b", "start", "length", "ids_crc32", "doc_tokens"]
    pieces = written(cut(docs, tokenizer, window).select(*alike).groupBy("doc_id", "a", "b", "start", "length", "ids_crc32", "doc_tokens").agg(F.count("*").alias("n")))
    shards = max(1, -(-(pieces.agg(F.sum("n")).first()[0] or 0) // shard_pieces))
    # the pieces of a document go to different shards; n pieces that are alike go round the shards, so a mass of them is at most
    # one row for each shard until it is packed
    own = F.pmod(F.xxhash64("a", "b", "start") + F.col("i"), F.lit(shards))
    dealt = pieces.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("n"), F.lit(shards)) - 1)))
    dealt = dealt.withColumn("shard", own.cast("long")).withColumn("copies", F.floor((F.col("n") - 1 - F.col("i")) / shards) + 1).drop("n", "i")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("shard").applyInPandas(_pack_shard(window), schema)


def padding(packed: DataFrame, window: int = WINDOW) -> DataFrame:
    """Tokens, sequences and padding of a packing; a sequence whose length is a power of two needs none."""
    length = F.sum("length")
    per = packed.groupBy("sequence_id").agg(length.alias("n"))
    power = F.col("n").bitwiseAND(F.col("n") - 1) == 0
    return per.agg(F.sum("n").alias("tokens"), F.count("*").alias("sequences"), F.sum(F.when(~power, window - F.col("n")).otherwise(0)).alias("padding"))

