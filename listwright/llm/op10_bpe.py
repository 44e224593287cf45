"""Byte-level BPE encoding and decoding.

Method: the bytes of a piece are mapped to Latin-1, an Aho-Corasick automaton over the vocabulary gives the longest
token at each place, and encoding backtracks from longest matches: a token is taken only if it is compatible with
the token before it, i.e. if encoding the two tokens' bytes gives exactly these two tokens. Compatibility of adjacent
tokens is memoised. Each byte is passed forward at most once for each place that is ruled out, so time is linear,
and the result equals the merges by rank.

Edge cases: a null or empty text has no tokens; its hashes are those of no bytes. Texts of any length are encoded
whole: they are cut only where the pattern must start a new match anyway (at a single space between two non-spaces).
Rows with equal ids are encoded one by one; other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listwright.llm.arrow import cache, map_columns

#: A vocabulary file is sent to the executors only up to this size.
MAX_VOCABULARY_BYTES = 64 << 20
#: Chunks that are remembered by a worker.
CACHE = 200_000


class Bpe:
    """The tokenizer of a rank file ("base64 rank" lines) and a split pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.bytes_of = {int(b): base64.b64decode(a) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.id_of = {v.decode("latin-1"): k for k, v in self.bytes_of.items()}
        self.text_of = {v: k for k, v in self.id_of.items()}
        self.pieces = regex.compile(pattern).findall
        self.cut = regex.compile(r"(?<=\S) (?=\S)").split
        self.automaton = ahocorasick.Automaton()
        for text, i in self.id_of.items():
            self.automaton.add_word(text, i)
        self.automaton.make_automaton()
        self.shorter: dict[int, int | None] = {}
        self.split: dict[int, tuple[int, int]] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        self.chunks: dict[str, tuple[str, bytes]] = {}  # entries by the text after a leading space
        self.older: dict[str, tuple[str, bytes]] = {}  # those before the last time that CACHE was reached
        self.merged: dict[tuple[int, int], int] = {}
        for i in sorted(self.text_of):
            if pair := self._last_merge(i):
                self.split[i] = pair
                self.merged[pair] = i
            self.compatible.clear()  # it held only for the merges so far

    def prefix(self, token: int) -> int | None:
        """The longest token that is a proper prefix of token."""
        if token not in self.shorter:
            text = self.text_of[token]
            self.shorter[token] = next((i for n in range(len(text) - 1, 0, -1) if (i := self.id_of.get(text[:n])) is not None), None)
        return self.shorter[token]

    def _last_merge(self, token: int) -> tuple[int, int] | None:
        """The two tokens that token is merged from by rank; None for a token that no merge makes."""
        text, left = self.text_of[token], self.prefix(token)
        while left is not None:
            right = self.id_of.get(text[len(self.text_of[left]) :])
            if right is not None and left < token and right < token and self.fits(left, right):
                return left, right
            left = self.prefix(left)
        return None

    def fits(self, left: int, right: int) -> bool:
        """Whether left and right stay as they are when their bytes are encoded together."""
        key = (left, right)
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 4 * CACHE:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(left, right)
        return known

    def _fits(self, a: int, b: int) -> bool:
        """Undo the later of the two last merges, again and again; no merge across the border may come before one undone."""
        merged, split, limit = self.merged.get, self.split.get, float("inf")
        while True:
            across = merged((a, b))
            if across is not None and across < limit:
                return False
            of_a, of_b = split(a), split(b)
            if of_a is None and of_b is None:
                return True
            if of_b is None or (of_a is not None and a > b):
                limit, a = a, of_a[1]
            else:  # at equal ranks the left merge comes first
                limit, b = b + 1, of_b[0]

    def longest(self, text: str, at: int) -> int:
        """The longest token that starts at a place; every byte is a token."""
        return next(self.automaton.iter_long(text, at))[1]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of a piece: longest matches from left to right, as long as each fits the one before; then with backtracking."""
        text = piece if piece.isascii() else piece.encode().decode("latin-1")
        whole = self.id_of.get(text)
        if whole is not None:
            return [whole]
        out: list[int] = []
        at, last, known, fits, text_of = 0, None, self.compatible.get, self.fits, self.text_of
        for end, token in self.automaton.iter_long(text):
            if last is not None and not (fits(last, token) if (ok := known((last, token))) is None else ok):
                return self._backtrack(text, out, at, token)
            out.append(token)
            last, at = token, end + 1
        return out

    def _backtrack(self, text: str, out: list[int], at: int, token: int | None) -> list[int]:
        """Go on from fitting tokens `out` up to a place where `token` is next: try its prefixes, else take back the last token."""
        text_of, n = self.text_of, len(text)
        ruled_out: set[int] = set()  # places from which no encoding goes on
        while token is not None:
            last = out[-1] if out else None
            while True:
                end = at + len(text_of[token])
                if end not in ruled_out and (last is None or self.fits(last, token)):
                    out.append(token)
                    at = end
                    token = self.longest(text, at) if at < n else None
                    break
                if (shorter := self.prefix(token)) is not None:
                    token = shorter
                else:
                    ruled_out.add(at)
                    if not out:
                        raise ValueError("the vocabulary cannot encode these bytes")
                    token = out.pop()
                    at -= len(text_of[token])
                    break
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.pieces(text) for i in self.encode_piece(p)]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def entry(self, ids: list[int]) -> tuple[str, bytes]:
        """Ids joined by spaces, and the bytes that these ids decode to."""
        return " ".join(map(str, ids)), self.decode(ids)

    def chunk(self, text: str) -> tuple[str, bytes]:
        """The entry of a space and a text without one; short ones are remembered. Letters alone are one match of the pattern, and so is a mark after them."""
        x = self.older.get(text)
        if x is None:
            if text[-1] in ",.;:!?" and text[:-1].isalpha():
                word, mark = self.chunks.get(text[:-1]) or self.chunk(text[:-1]), self.encode_piece(text[-1])[0]
                x = f"{word[0]} {mark}", word[1] + self.bytes_of[mark]
            else:
                x = self.entry(self.encode_piece(" " + text) if text.isalpha() else self.encode(" " + text))
        if len(text) < 60:
            if len(self.chunks) > CACHE:
                self.chunks, self.older = {}, self.chunks
            self.chunks[text] = x
        return x

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the bytes that these ids decode to."""
        found: list[tuple[str, bytes]] = []
        if text:
            first, *rest = text.split(" ")
            found = list(map(self.chunks.get, rest))
            if None in found:
                todo = {p for p, x in zip(rest, found, strict=True) if x is None}
                if any(not p or p[0].isspace() or p[-1].isspace() for p in todo):
                    first, *rest = self.cut(text)
                    found = list(map(self.chunks.get, rest))
                    todo = {p for p, x in zip(rest, found, strict=True) if x is None}
                new = {p: self.chunk(p) for p in todo}
                found = [new[p] if x is None else x for p, x in zip(rest, found, strict=True)]
            if first:
                found.insert(0, self.entry(self.encode(first)))
        ids, decoded = zip(*found, strict=True) if found else ((), ())
        ids_text = " ".join(ids)
        return ids_text.count(" ") + bool(ids_text), hashlib.sha256(ids_text.encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()


def _tokenizer(broadcast, pattern: str) -> Bpe:
    rank_file = broadcast.value
    key, loaded = (hashlib.sha256(rank_file).hexdigest(), pattern), cache(__name__)
    if key not in loaded:
        loaded[key] = Bpe(rank_file, pattern)
    return loaded[key]


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver; files larger than MAX_VOCABULARY_BYTES are refused."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY_BYTES} bytes")
    return data


def encode_documents(docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every text: the id column, ids array<int>. A null text has none."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(key, text):
        bpe = _tokenizer(ranks, pattern)
        return {"key": key, "ids": [bpe.encode(t or "") for t in text]}

    return map_columns(docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")), "key long, ids array<int>", run).withColumnRenamed("key", id_col)


def decode_documents(encoded: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id") -> DataFrame:
    """Bytes that ids decode to: the id column, decoded binary."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(key, ids):
        bpe = _tokenizer(ranks, pattern)
        return {"key": key, "decoded": [bpe.decode(i or []) for i in ids]}

    return map_columns(encoded.select(F.col(id_col).cast("long").alias("key"), "ids"), "key long, decoded binary", run).withColumnRenamed("key", id_col)


def digest_documents(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text, in one pass without a shuffle."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))

    def run(doc_id, text):
        bpe = _tokenizer(ranks, pattern)
        n, ids, decoded = zip(*map(bpe.digest, text))
        return {"doc_id": doc_id, "n_tokens": n, "ids_sha256": ids, "decoded_sha256": decoded}

    return map_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", run)
