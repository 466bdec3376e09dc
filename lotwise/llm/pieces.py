"""SentencePiece encoding and decoding by suffix-array matching.

The new words of a batch (runs that no piece can cross) are joined into one text; its suffix array is built by prefix doubling
to the longest piece's length; every piece's range of occurrences is found by binary search, all pieces at a time; the
occurrences, sorted by position, are the edges of each word's lattice, and are relaxed from left to right. Under byte-pair
merges the pieces of a prefix are fixed: an edge extends a prefix just when its piece and the prefix's last one stay
apart when merged alone, so at most one edge holds at each place, and it is the library's own encoding. Characters of
no piece fall back to bytes. Words met before are remembered up to a bound.
"""

from __future__ import annotations

import re
import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

SPACE = "▁"
CACHED_WORDS = 700_000
CACHED_PAIRS = 1_000_000
#: Characters of the longest word that is remembered.
REMEMBERED = 256
#: Characters of new words that are indexed at a time.
INDEXED = 2_000_000
#: Places of a word whose edges are relaxed with those of other words; edges beyond them that are lists at a time.
ABREAST, ONE_BY_ONE = 64, 100_000


def suffix_array(codes, depth: int):
    """Places of ``codes`` in the order of what starts there, compared to ``depth`` symbols: as many symbols as fit into a word at
    first, then prefix doubling."""
    import numpy as np

    symbols = np.unique(codes)
    dense = np.searchsorted(symbols, codes).astype("int64") + 1
    bits = int(len(symbols) + 1).bit_length()
    width, n = max(1, 62 // bits), len(codes)
    key = np.zeros(n, "int64")
    for k in range(width):
        key <<= bits
        key[: max(0, n - k)] |= dense[k:]
    order = np.argsort(key)
    while width < depth:
        rank = np.empty(n, "int64")
        rank[order] = np.r_[0, np.cumsum(np.diff(key[order]) != 0)]
        key = rank * (n + 1)
        if width < n:
            key[: n - width] += rank[width:] + 1
        order = np.argsort(key)
        width *= 2
    return order


def _refuse_others(model, path: str) -> None:
    """A model of another kind would be encoded wrongly and nobody would see it, so it is refused."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto.FromString(model.serialized_model_proto())
    trainer, norm = proto.trainer_spec, proto.normalizer_spec
    fine = trainer.model_type == trainer.BPE and trainer.byte_fallback and not trainer.treat_whitespace_as_suffix
    fine = fine and norm.name == "identity" and not norm.precompiled_charsmap and norm.add_dummy_prefix and not norm.remove_extra_whitespaces and norm.escape_whitespaces
    if not fine:
        raise ValueError(f"{path}: not a byte-pair model with byte fallback, an identity normaliser and a blank in front")


class Pieces:
    """A byte-pair SentencePiece model with byte fallback, an identity normaliser and a blank in front of every text."""

    def __init__(self, path: str):
        import numpy as np
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        _refuse_others(model, path)
        n = model.vocab_size()
        self.text = [model.id_to_piece(i) for i in range(n)]
        self.rank = [-model.get_score(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.ids = {self.text[i]: i for i in plain}
        self.bytes = {int(self.text[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.control = {i for i in range(n) if model.is_control(i) or model.is_unknown(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.depth, self.lengths = max(map(len, self.ids)), list(map(len, self.text))
        self.table = np.zeros((len(plain), self.depth), "uint32")
        for k, i in enumerate(plain):
            self.table[k, : len(self.text[i])] = [ord(c) for c in self.text[i]]
        self.length = (self.table > 0).sum(1)
        self.plain = np.array(plain)
        letters = {c for p in self.ids for c in p} - {SPACE}
        known = "".join(re.escape(c) for c in sorted(letters))
        # a word: blanks and what follows them; a character of no piece stands alone
        self.word = re.compile(f"{SPACE}+[{known}]*|[{known}]+|[^{SPACE}{known}]")
        self.known: dict[str, bytes] = {}
        self.start = n  # stands for no piece before
        self.apart: dict[int, bool] = {}
        self.ranked = {t: self.rank[i] for t, i in self.ids.items()}
        # as ``apart``, for many at a time: sorted keys, and whether they stay apart
        self.pairs, self.fine = np.zeros(0, "int64"), np.zeros(0, "bool")
        # what each id says; bytes of ASCII say their character, longer sequences of bytes are put together on their own
        self.said = ["" if i in self.control else chr(self.byte_of[i]) if self.byte_of.get(i, 128) < 128 else t.replace(SPACE, " ") for i, t in enumerate(self.text)]
        self.high = np.array([self.byte_of.get(i, 0) >= 128 for i in range(n)])

    def merged(self, text: str) -> list[int]:
        """Byte-pair merges of a short text: the best-ranked pair first, then the leftmost."""
        parts, rank, never = list(text), self.ranked.get, float("inf")
        ranks = [rank(a + b, never) for a, b in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < never:
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del ranks[k]
            if k < len(ranks):
                ranks[k] = rank(parts[k] + parts[k + 1], never)
            if k:
                ranks[k - 1] = rank(parts[k - 1] + parts[k], never)
        return [self.ids.get(p, -1) for p in parts]

    def stay_apart(self, a: int, b: int) -> bool:
        """Whether two neighbours are what their joint text is encoded to (or, at a start, whether a piece encodes itself)."""
        key = a * (self.start + 1) + b
        if (known := self.apart.get(key)) is None:
            if len(self.apart) > CACHED_PAIRS:
                self.apart.clear()
            known = self.apart[key] = self._apart(a, b)
        return known

    def _apart(self, a: int, b: int) -> bool:
        want = [b] if a == self.start else [a, b]
        return self.merged("".join(self.text[i] for i in want)) == want

    def _all_apart(self, keys):
        """``stay_apart`` of many pairs, each as the key a * (start + 1) + b."""
        import numpy as np

        at = np.minimum(np.searchsorted(self.pairs, keys), max(0, len(self.pairs) - 1))
        new = np.unique(keys[self.pairs[at] != keys] if len(self.pairs) else keys)
        if len(new):
            told = np.array([self._apart(*divmod(k, self.start + 1)) for k in new.tolist()], "bool")
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.fine = np.insert(self.pairs, place, new), np.insert(self.fine, place, told)
            at = np.searchsorted(self.pairs, keys)
        return self.fine[at]

    def edges(self, text: str, ordered: bool = True):
        """Starts, ends and ids of every occurrence of every piece, by start if ``ordered``."""
        import numpy as np

        codes = np.frombuffer(text.encode("utf-32-le"), "uint32").astype("int64")
        order = suffix_array(codes, self.depth)
        n = len(codes)
        padded = np.r_[codes, np.zeros(self.depth, "int64")]
        lo, hi = np.zeros(len(self.plain), "int64"), np.full(len(self.plain), n, "int64")
        for k in range(self.depth):
            live = np.flatnonzero((self.length > k) & (lo < hi))
            if not len(live):
                break
            want = self.table[live, k].astype("int64")
            a = self._bound(order, padded, k, want, lo[live], hi[live], False)
            b = self._bound(order, padded, k, want, a, hi[live], True)
            lo[live], hi[live] = a, b
        count = hi - lo
        owner = np.repeat(np.arange(len(count)), count)
        places = order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
        size = self.length[owner]
        if not ordered:
            return places, places + size, self.plain[owner]
        by = np.argsort(places)
        return places[by], (places + size)[by], self.plain[owner][by]

    @staticmethod
    def _bound(order, padded, k: int, want, lo, hi, after: bool):
        """In each range [lo, hi) of the order, the first place whose k-th symbol is not below (or is above) ``want``."""
        import numpy as np

        lo, hi = lo.copy(), hi.copy()
        while len(open_ := np.flatnonzero(lo < hi)):
            mid = (lo[open_] + hi[open_]) // 2
            symbol = padded[order[mid] + k]
            low = symbol <= want[open_] if after else symbol < want[open_]
            lo[open_[low]] = mid[low] + 1
            hi[open_[~low]] = mid[~low]
        return lo

    def learn(self, words: list[str]) -> None:
        """Encodes new words, all in one text, of which INDEXED characters at a time are indexed: a word of any length takes no
        more memory than four bytes for each of its characters beside that.

        Edges that start at the same place of their words are relaxed together, for all words at a time; those beyond ABREAST places one by one."""
        import numpy as np

        text = "\0".join(words)
        last = np.full(len(text) + 1, -1, "int32")  # the piece that ends here in the encoding of the word so far; -1: none
        factor = self.start + 1
        if len(self.pairs) > CACHED_PAIRS:
            self.pairs, self.fine = self.pairs[:0], self.fine[:0]
        size = np.fromiter(map(len, words), "int64", len(words))
        begin = np.cumsum(size + 1) - size - 1
        last[begin] = self.start
        done, ends, starts = 0, (begin + size).tolist(), begin.tolist()
        for window in range(0, len(text), INDEXED):
            i, j, piece = self.edges(text[window : window + INDEXED + self.depth - 1], ordered=False)
            own = i < INDEXED
            i, j, piece = i[own] + window, j[own] + window, piece[own]
            into = i - begin[np.searchsorted(begin, i, "right") - 1]
            order = np.argsort(np.minimum(into, ABREAST).astype("uint8"), kind="stable")
            i, j, piece = i[order], j[order], piece[order]
            cuts = np.searchsorted(np.minimum(into, ABREAST)[order], np.arange(ABREAST + 1)).tolist()
            for a, b in zip(cuts, cuts[1:]):  # noqa: B905
                if a < b:
                    before = last[i[a:b]]
                    live = np.flatnonzero((before >= 0) & (last[j[a:b]] < 0))
                    live = live[self._all_apart(before[live].astype("int64") * factor + piece[a:b][live])]
                    last[j[a:b][live]] = piece[a:b][live]
            if cuts[-1] < len(i):
                self._one_by_one(i[cuts[-1] :], j[cuts[-1] :], piece[cuts[-1] :], last)
            stop = done
            while stop < len(words) and ends[stop] <= window + INDEXED:
                stop += 1
            if done < stop:
                some = array("i", last[starts[done] : ends[stop - 1] + 1].tobytes())
                for k in range(done, stop):
                    self.known[words[k]] = self._back(words[k], starts[k] - starts[done], ends[k] - starts[done], some)
                done = stop

    def _one_by_one(self, i, j, piece, last) -> None:
        import numpy as np

        order, apart, stay, factor, last = np.argsort(i, kind="stable"), self.apart, self.stay_apart, self.start + 1, memoryview(last)
        for at in range(0, len(order), ONE_BY_ONE):
            some = order[at : at + ONE_BY_ONE]
            for a, b, p in zip(i[some].tolist(), j[some].tolist(), piece[some].tolist(), strict=True):
                before = last[a]
                if before >= 0 and last[b] < 0:
                    fine = apart.get(before * factor + p)
                    if fine or fine is None and stay(before, p):
                        last[b] = p

    def _back(self, word: str, begin: int, stop: int, last) -> bytes:
        if last[stop] < 0:  # a character of no piece
            return array("I", [self.bytes[b] for b in word.encode()]).tobytes()
        out, j, length = array("I"), stop, self.lengths
        while j > begin:
            out.append(last[j])
            j -= length[last[j]]
        out.reverse()
        return out.tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        split = [self.word.findall((SPACE + t.replace(" ", SPACE)) if t else "") for t in texts]
        new = list(set().union(*split).difference(self.known))
        at = 0
        while at < len(new):
            size, stop = 0, at
            while stop < len(new) and size < INDEXED:
                size, stop = size + len(new[stop]), stop + 1
            self.learn(new[at:stop])
            at = stop
        out = [b"".join(map(self.known.__getitem__, ws)) for ws in split]
        for word in new:
            if len(word) > REMEMBERED:
                del self.known[word]
        return out

    def decode(self, ids) -> str:
        """The text of ids, an array of integers or their bytes."""
        import numpy as np

        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else np.asarray(ids, "int64")
        if not self.high[ids].any():
            return "".join(map(self.said.__getitem__, ids.tolist())).removeprefix(" ")
        out, run = [], bytearray()
        for i in ids.tolist():
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            out += [run.decode("utf-8", "replace"), self.said[i]]
            run.clear()
        return "".join([*out, run.decode("utf-8", "replace")]).removeprefix(" ")


_models: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encode_documents(docs: DataFrame, model: str, keep_ids: bool = True) -> DataFrame:
    """doc_id, n_pieces, ids_crc32 (of little-endian 32-bit ids), restored (the decoded ids are the text), and ``ids``.

    Null texts count as empty and have no pieces. A text that holds the blank's own sign isn't restored letter by letter, as
    in the library: the sign decodes to a blank. Repeated rows are answered one by one; other columns are ignored.
    """
    names = ["doc_id", "n_pieces", "ids_crc32", "restored"] + ["ids"] * keep_ids

    def convert(batch) -> dict:
        import numpy as np

        own = pieces(model)
        texts = [t or "" for t in batch.column("text").to_pylist()]
        out = {n: [] for n in names} | {"doc_id": batch.column("doc_id")}
        for text, ids in zip(texts, own.encode(texts), strict=True):
            out["n_pieces"].append(len(ids) // 4)
            out["ids_crc32"].append(zlib.crc32(ids))
            out["restored"].append(own.decode(ids) == text)
            if keep_ids:
                out["ids"].append(np.frombuffer(ids, "<i4"))
        return out

    schema = "doc_id long, n_pieces long, ids_crc32 long, restored boolean" + ", ids array<int>" * keep_ids
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), convert, schema)


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from ``ids``; null ids give an empty text."""

    def convert(batch) -> dict:
        own = pieces(model)
        return {"doc_id": batch.column("doc_id"), "text": [own.decode(x or []) for x in batch.column("ids").to_pylist()]}

    return map_arrow(encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), convert, "doc_id long, text string")
