"""Token counts by the whole-token shortcut.

Which pre-tokens are one token is proven once, from the vocabulary file alone:
every vocabulary string that ends a word is merged from its characters, and
those that come out as one token form the whole set. A text's pre-tokens in
that set count 1 each; only the rest are merged, by the tokenizer library's
own BPE model, once for each distinct one that a task meets.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commitgrain.llm import _bpe
from commitgrain.llm._common import columns


_other = re.compile("[^\x00-\u024F\u2010-\u2027]").search


class Counter:
    """Counts tokens of texts for a word-end BPE file: NFC, runs of white space
    to one space, lower case; pre-tokens by the file's pattern."""

    def __init__(self, path: str):
        spec = _bpe.load(path)
        self.ranks = _bpe.merge_ranks(spec["model"])
        self.end = spec["model"]["end_of_word_suffix"]
        self.letters = _bpe.byte_letters()
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"]).findall
        self.special = regex.compile("|".join(regex.escape(s) for s in _bpe.special_strings(path)))
        back = {c: b for b, c in enumerate(self.letters)}
        self.whole = set()
        for word in spec["model"]["vocab"]:
            if word.endswith(self.end) and len(self.merged(word[: -len(self.end)])) == 1:
                try:
                    self.whole.add(bytes(back[c] for c in word[: -len(self.end)]).decode())
                except UnicodeDecodeError:
                    continue  # part of a character: no pre-token
        self.mark = _bpe.mark(path)
        library = tokenizers.Tokenizer.from_file(path)
        merged, self.normal_form = library.model.tokenize, library.normalizer.normalize_str
        letter = self.letters.__getitem__
        self.counts = _bpe.Memo(lambda piece: 1 if piece in self.whole else len(merged("".join(map(letter, piece.encode())))), 500_000)

    def merged(self, letters: str) -> list[str]:
        """Tokens of one pre-token that is given in the vocabulary's letters."""
        return _bpe.merge([*letters[:-1], letters[-1] + self.end], self.ranks) if letters else []

    def normal(self, text: str) -> str:
        """Composed and in lower case. Latin letters and plain punctuation have
        no marks to compose and one lower case each; anything else is left to
        the library, whose tables may be of another edition than Python's."""
        return self.normal_form(text) if _other(text) else text.lower()

    def count(self, text: str) -> int:
        total = 0
        if self.mark in text:
            parts = self.special.split(text)
            total = len(parts) - 1
        else:
            parts = (text,)
        for part in parts:
            total += sum(map(self.counts.__getitem__, self.pieces(self.normal(part))))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, vocabulary: str, *, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """One row a document: doc_id, n_bytes, n_tokens, over_limit.

    Null text is empty and has 0 tokens; strings of special tokens inside a
    text are one token each; rows are independent, so repeated ids give a row
    each, a null id stays null, and an empty table gives none. `vocabulary` is the path of the file, which
    every executor must have. One pass without a shuffle; a task holds one
    Arrow batch and a table of at most Memo.limit pre-tokens.
    """
    def run(batches):
        count = counter(vocabulary).count
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                n = [0 if t is None else count(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    base = columns(docs, key, text).toDF("doc_id", "text")
    base = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    return base.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
