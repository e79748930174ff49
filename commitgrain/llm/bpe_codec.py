"""Exact byte-level BPE in linear time, and its inverse.

A list of tokens is the BPE encoding of its bytes if and only if each token
encodes to itself and each neighbouring pair is compatible: merging the two
tokens' bytes gives just these two. So the encoder walks the text with the
longest vocabulary match at each place (found by one Aho-Corasick pass), steps
to the next shorter prefix where a pair is not compatible, and goes back one
token where no prefix is left. Places found dead are marked, so each is tried
once. The pair table fills as pairs occur.

Whether a pair (a, b) is compatible follows from how each token is built. On
its way to a, the last symbol before the border is in turn each symbol of a's
right edge, and each lives until its parent's merge; likewise for b's left
edge. The border breaks when two such symbols have a merge that comes before
either one's parent's (at equal rank the leftmost goes first).

Decoding gathers the tokens' bytes from one buffer by an offset table.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgrain.llm import _bpe
from commitgrain.llm._common import columns

#: Fixed value: the pattern by which byte-level vocabularies of this kind split a text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Codec:
    def __init__(self, path: str):
        spec = _bpe.load(path)
        how = spec["pre_tokenizer"]
        if (how["type"], how["use_regex"], how["add_prefix_space"], spec["normalizer"]) != ("ByteLevel", True, False, None):
            raise ValueError("only byte-level vocabularies whose texts are split by PATTERN as they are")
        self.mark = _bpe.mark(path)
        letters = _bpe.byte_letters()
        to_byte = {c: chr(b) for b, c in enumerate(letters)}
        self.special_ids = _bpe.special_strings(path)
        self.ranks = {(self._raw(a, to_byte), self._raw(b, to_byte)): r for (a, b), r in _bpe.merge_ranks(spec["model"]).items()}
        vocab = {self._raw(t, to_byte): i for t, i in spec["model"]["vocab"].items() if t not in self.special_ids}
        self.after: dict[str, dict[str, int]] = {}  # ranks by first symbol, then second
        for (a, b), r in self.ranks.items():
            self.after.setdefault(a, {})[b] = r
        self.halves = {a + b: (a, b, r) for (a, b), r in reversed(self.ranks.items())}
        self.left_edge, self.right_edge = _bpe.Memo(lambda t: self._edge(t, 0)), _bpe.Memo(lambda t: self._edge(t, 1))
        self.pairs = _bpe.Memo(self._compatible, 300_000)
        # a token that merging does not produce from its own bytes never occurs
        self.ids = {t: i for t, i in vocab.items() if len(t) == 1 or t in self.halves and self._whole(t)}
        self.shorter = {t: next((t[:n] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), None) for t in self.ids}
        self.match = ahocorasick.Automaton()
        for t in self.ids:
            self.match.add_word(t, len(t))
        self.match.make_automaton()
        self.pieces = regex.compile(PATTERN).findall
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special_ids) + ")")
        self.memo = _bpe.Memo(self._piece, 500_000)
        # the offset table for decoding
        size = max([*vocab.values(), *self.special_ids.values()]) + 1
        every = [b""] * size
        for t, i in vocab.items():
            every[i] = t.encode("latin-1")
        for t, i in self.special_ids.items():
            every[i] = t.encode()
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in every])]).astype(np.int64)
        self.buffer = np.frombuffer(b"".join(every), np.uint8)

    @staticmethod
    def _raw(token: str, to_byte: dict[str, str]) -> str:
        return "".join(to_byte.get(c, c) for c in token)

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """Symbols along one edge of a token's merges, each with the rank at
        which it goes into its parent."""
        out: list[tuple[str, float]] = [(token, float("inf"))]
        while token in self.halves:
            *both, rank = self.halves[token]
            token = both[side]
            out.append((token, rank))
        return out

    def _compatible(self, pair: tuple[str, str], before: float = float("inf")) -> bool:
        left, after = self.left_edge[pair[1]], self.after
        for x, x_until in self.right_edge[pair[0]]:
            if ranks := after.get(x):
                for y, y_until in left:
                    if y in ranks and (r := ranks[y]) < before and r < x_until and r <= y_until:
                        return False
        return True

    def _whole(self, token: str) -> bool:
        """Whether the token's two halves meet unbroken until their merge."""
        a, b, rank = self.halves[token]
        return (len(a) == 1 or self._whole(a)) and (len(b) == 1 or self._whole(b)) and self._compatible((a, b), rank)

    def _piece(self, piece: str) -> bytes:
        raw = piece.encode().decode("latin-1")
        if raw in self.ids:
            return self.ids[raw].to_bytes(4, "little")
        return b"".join(self.ids[t].to_bytes(4, "little") for t in self.backtrack(raw))

    def backtrack(self, raw: str) -> list[str]:
        """Tokens of one pre-token, given as one character a byte."""
        n, pairs, shorter = len(raw), self.pairs, self.shorter
        longest = [0] * n
        for end, size in self.match.iter(raw):
            if size > longest[end - size + 1]:
                longest[end - size + 1] = size
        dead = bytearray(n + 1)
        out: list[str] = []
        at, last = 0, None
        token = raw[: longest[0]] if n else None
        while at < n:
            end = at + len(token)
            if not dead[end] and (last is None or pairs[last, token]):
                out.append(token)
                at, last = end, token
                if at < n:
                    token = raw[at : at + longest[at]]
                continue
            token = shorter[token]
            while token is None:  # nothing fits here: this place is dead, shorten the token before it
                dead[at] = 1
                before = out.pop()
                last = out[-1] if out else None
                at -= len(before)
                token = shorter[before]
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        memo = self.memo
        if self.mark not in text:
            return b"".join([memo[p] for p in self.pieces(text)])
        out = []
        for i, part in enumerate(self.special.split(text)):
            if i % 2:
                out.append(self.special_ids[part].to_bytes(4, "little"))
            else:
                out += [memo[p] for p in self.pieces(part)]
        return b"".join(out)

    def decode(self, each: list[np.ndarray]) -> list[bytes]:
        """UTF-8 of the decoded text of each list of ids; bytes that are no
        UTF-8 become U+FFFD. The lists are gathered at once."""
        ids = np.concatenate([np.zeros(0, np.int32), *each])
        first = self.offsets[ids]
        size = self.offsets[ids + 1] - first
        ends = np.cumsum(size)
        raw = self.buffer[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)].tobytes()
        ends = np.concatenate([[0], ends])[np.cumsum([0, *map(len, each)])]
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: doc_id, ids (list of token ids).

    Null text is empty and has no ids; strings of special tokens inside a text
    become their ids; repeated ids give a row each, a null id stays null, an
    empty table gives none. One pass without a shuffle.
    """
    def run(batches):
        to_ids = codec(vocabulary).encode
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                raw = [to_ids(t or "") for t in part.column(1).to_pylist()]
                firsts = np.concatenate([[0], np.cumsum([len(r) // 4 for r in raw])])
                ids = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(np.frombuffer(b"".join(raw), "<i4"), pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], ["doc_id", "ids"])

    base = columns(docs, key, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256, text for each row of ids; null ids are none."""
    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                each = [np.zeros(0, np.int32) if not x.is_valid else x.values.to_numpy() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(x) for x in each], pa.int64()), pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in each]),
                     pa.array([x.decode() for x in c.decode(each)], pa.string())], ["doc_id", "ids", "n_tokens", "ids_sha256", "text"])

    return columns(encoded, key, ids).toDF("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, text string")


def round_trip(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document, and ids
    where they are asked for: `encode` and `decode` in one pass, so that a task
    holds the vocabulary once. Nulls and repeated ids are as in `encode`."""
    def run(batches):
        c = codec(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                raw = [c.encode(t or "") for t in part.column(1).to_pylist()]
                each = [np.frombuffer(r, "<i4") for r in raw]
                columns_ = [part.column(0), pa.array([len(x) for x in each], pa.int64()), pa.array([hashlib.sha256(r).hexdigest() for r in raw], pa.string()),
                            pa.array([hashlib.sha256(x).hexdigest() for x in c.decode(each)], pa.string())]
                if with_ids:
                    firsts = np.concatenate([[0], np.cumsum([len(x) for x in each])])
                    columns_.append(pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(np.concatenate(each), pa.int32())))
                yield pa.RecordBatch.from_arrays(columns_, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids])

    base = columns(docs, key, text).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return base.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
