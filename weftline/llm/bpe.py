"""Byte-pair encoding and decoding with a pair occurrence index.

The distinct words of a block are laid out in one symbol array. An index maps each
mergeable pair to all its positions; ranks with positions are taken in ascending
order from a heap, every occurrence of the pair is merged at once, and the lists of
the pairs that arise left and right of the merges are updated. Words are told apart
by a separator symbol, so that no pair spans two words. Encoded words are kept in a
bounded table per Python worker.

The vocabulary (a ``tokenizers`` JSON file of a byte-level BPE) is a parameter; it is
read where the task runs.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from functools import lru_cache
from itertools import accumulate
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import pre_tokenizers

from weftline.llm.common import blocks, bounded, texts

#: Pre-tokenisation of byte-level BPE (fixed value of the format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
KEPT_BYTES = 64 << 20  # of a worker's table of encoded words, with what Python needs for each


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=1)
def newer_letters() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Letters and digits of the ``regex`` tables that the ``tokenizers`` library's older Unicode tables lack.

    As a class that finds a text that may hold one (one range: quick), the class of those
    in the basic plane, and the class of those beyond it (long, so used only on texts with such characters).
    """
    known = regex.findall(r"[\p{L}\p{N}\s]", "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)])))
    pieces = pre_tokenizers.ByteLevel(add_prefix_space=False).pre_tokenize_str
    lacking = lambda c: len(pieces(c + ("a" if regex.match(r"\p{L}", c) else "1"))) > 1
    newer = [c for c in known if unicodedata.category(c) == "Cn" and lacking(c)] or ["\U0010ffff"]
    near, far = [c for c in newer if c < "\U00010000"] or ["\uffff"], [c for c in newer if c >= "\U00010000"] or ["\U0010ffff"]
    return re.compile(f"[{re.escape(min(newer))}-\U0010ffff]"), re.compile("[" + "".join(map(re.escape, near)) + "]"), re.compile("[" + "".join(map(re.escape, far)) + "]")


class PairIndexBPE:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.size = 1 + max(max(vocab.values()), max((t["id"] for t in spec["added_tokens"]), default=0))
        self.bytes_of: list[bytes] = [b""] * self.size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        code = left * self.size + right
        order = np.argsort(code, kind="stable")
        self._codes, self._ranks = code[order], order
        self._left, self._right = left.tolist(), right.tolist()
        self._merged = [vocab[a + b] for a, b in merges]
        self._byte_id = np.array([vocab[c] for c in symbols], np.int64)
        self._find_known = regex.compile(WORDS).findall
        self._maybe, self._near, self._far = newer_letters()
        self._split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")").split if self.added else None
        self._kept: dict[str, bytes] = {}
        self._kept_bytes = 0

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; -1 where a pair has none (separators have none)."""
        code = np.where((a >= 0) & (b >= 0), a * self.size + b, -1)
        at = np.minimum(np.searchsorted(self._codes, code), len(self._codes) - 1)
        return np.where(self._codes[at] == code, self._ranks[at], -1)

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each (nonempty) word as little-endian 32-bit integers."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        sym = self._byte_id[data]
        ends = np.cumsum(size + 1) - 1
        sym[ends] = -1
        n = len(sym)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        live = np.ones(n, bool)
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(places: np.ndarray) -> None:
            places = places[(places >= 0) & (places < n)]
            after = nxt[places]
            places, after = places[after < n], after[after < n]
            rank = self._rank(sym[places], sym[after])
            places, rank = places[rank >= 0], rank[rank >= 0]
            if not len(rank):
                return
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cuts = np.flatnonzero(np.diff(rank)) + 1
            for r, p in zip(rank[np.concatenate(([0], cuts))].tolist(), np.split(places, cuts)):
                if r in index:
                    index[r].append(p)
                else:
                    index[r] = [p]
                    heapq.heappush(heap, r)

        post(np.arange(n - 1))
        while heap:
            r = heapq.heappop(heap)
            lists = index.pop(r)
            places = np.unique(np.concatenate(lists)) if len(lists) > 1 else lists[0]
            a, b = self._left[r], self._right[r]
            after = np.minimum(nxt[places], n - 1)
            places = places[live[places] & (sym[places] == a) & (sym[after] == b) & (nxt[places] < n)]
            if a == b and len(places) > 1:  # runs of one symbol: pairs from the left, without overlap
                taken, last = [], -1
                for p in places.tolist():
                    if p != last:
                        taken.append(p)
                        last = int(nxt[p])
                places = np.array(taken, np.int64)
            if not len(places):
                continue
            gone = nxt[places]
            beyond = nxt[gone]
            sym[places] = self._merged[r]
            live[gone] = False
            nxt[places] = beyond
            inside = beyond < n
            prv[beyond[inside]] = places[inside]
            # where the next symbol was merged too, its own place goes on; links are set for all merges before pairs are posted
            post(np.unique(np.concatenate((prv[places], places))))
        ids = sym[live]
        cut = np.flatnonzero(ids < 0)
        flat = ids.astype("<u4").tobytes()
        first = np.concatenate(([0], cut[:-1] + 1)) * 4
        return [flat[s:e] for s, e in zip(first.tolist(), (cut * 4).tolist())]

    def _find(self, text: str) -> list[str]:
        """Words of a text. Letters that the format's Unicode version lacks count as symbols."""
        if text.isascii() or not self._maybe.search(text):
            return self._find_known(text)
        plain = self._near.sub("\ue000", text)
        if max(text) > "\uffff":
            plain = self._far.sub("\ue000", plain)
        if plain == text:
            return self._find_known(text)
        found = self._find_known(plain)
        ends = list(accumulate(map(len, found)))
        return [text[e - len(w) : e] for w, e in zip(found, ends)]

    def _encoded(self, found: list[str]) -> bytes:
        return b"".join(map(self._kept.__getitem__, found))

    def encode_many(self, many: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; special tokens' strings become their ids."""
        pieces: list[list] = []
        new: set[str] = set()
        for text in many:
            if self._split and any(t in text for t in self.added):
                parts = [p for p in self._split(text) if p]
                own = [self.added[p].to_bytes(4, "little") if p in self.added else self._find(p) for p in parts]
            else:
                own = [self._find(text)]
            pieces.append(own)
            for p in own:
                if not isinstance(p, bytes):
                    new.update(p)
        if self._kept_bytes > KEPT_BYTES:
            self._kept.clear()
            self._kept_bytes = 0
        fresh = [w for w in new if w not in self._kept]
        if fresh:
            found = self.encode_words(fresh)
            self._kept.update(zip(fresh, found))
            self._kept_bytes += sum(map(len, fresh)) + sum(map(len, found)) + 128 * len(fresh)
        return [b"".join(p if isinstance(p, bytes) else self._encoded(p) for p in own) for own in pieces]

    def decode(self, ids: bytes) -> str:
        """Text of ids, special tokens kept; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> PairIndexBPE:
    """One per Python worker."""
    return PairIndexBPE(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, decoded string): ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids and decode to the empty text. Other columns of
    ``df`` are not read. One row per input row; ids and rows may repeat. A narrow map:
    no shuffle, memory bounded by a block of texts and the kept words.
    """
    source = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path)
        for block in blocks(batches):
            ids = bpe.encode_many(texts(block))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(ids, pa.binary()), pa.array(map(bpe.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    return bounded(source).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """One row per document: number of ids and digests of ids and decoded text."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
