"""Token counts by byte-pair merging over a heap and a linked list; no identifiers are made.

A word starts as one symbol a byte, the last marked as the word's end. The adjacent pair of
lowest rank is merged again and again; the count is the initial symbols minus the merges.
Counts of words and of white-space-free chunks are kept by each worker, in tables of bounded bytes.

Defined cases: a null text is an empty one with 0 bytes and 0 tokens; special strings inside a
text count one token each, as in the library; repeated rows are counted each; an empty table
gives an empty result; texts are never cut.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import common, tokenizers_

#: Unicode's white space. str.split() takes U+001C to U+001F as well.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
_SPLIT, _ODD = re.compile(f"[{SPACE}]+"), re.compile("[\x1c-\x1f]")


def lowered(chunk: str) -> str:
    """Composed and in lower case, each character by itself as in the library: a last sigma is like any other."""
    if chunk.isascii():
        return chunk.lower()
    return unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()


class HeapCounter:
    """Counts tokens of texts for a word-level byte-pair vocabulary with an end-of-word mark."""

    def __init__(self, path: str) -> None:
        d = tokenizers_.description(path)
        model, end = d["model"], d["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.pairs: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            self.pairs.setdefault(vocab[a] << 20 | vocab[b], (rank, vocab[a + b]))
        chars = tokenizers_.byte_chars()
        self.inner = [vocab[chars[b]] for b in range(256)]
        self.last = [vocab[chars[b] + end] for b in range(256)]
        special = [t["content"] for t in d["added_tokens"] if t["special"]]
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))))
        split = d["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", SPACE)
        self.pattern = regex.compile(split)
        self.path, self.unsettled = path, tokenizers_.unsettled().search
        self.words, self.chunks = common.Table(), common.Table()

    def merge(self, symbols: list[int]) -> int:
        """Symbols left after all merges."""
        n = left = len(symbols)
        pairs = self.pairs
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]
        heap = [(p[0], i, k, p[1]) for i in range(n - 1) if (p := pairs.get(k := symbols[i] << 20 | symbols[i + 1]))]
        heapify(heap)
        while heap:
            _, i, k, new = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] << 20 | symbols[j] != k:  # one of the two has been merged meanwhile
                continue
            symbols[i], symbols[j] = new, -1
            left -= 1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if p := pairs.get(k := new << 20 | symbols[j]):
                    heappush(heap, (p[0], i, k, p[1]))
            h = before[i]
            if h >= 0 and (p := pairs.get(k := symbols[h] << 20 | new)):
                heappush(heap, (p[0], h, k, p[1]))
        return left

    def split(self, chunk: str) -> list[str]:
        """The words of a chunk; where tables of characters may differ, the library splits."""
        if not self.unsettled(chunk):
            return self.pattern.findall(lowered(chunk))
        plain = {c: b for b, c in tokenizers_.byte_chars().items()}
        t = tokenizers_.library(self.path)
        return [bytes(plain[c] for c in w).decode() for w, _ in t.pre_tokenizer.pre_tokenize_str(t.normalizer.normalize_str(chunk))]

    def word(self, word: str) -> int:
        n = self.words.get(word)
        if n is None:
            raw = word.encode()
            symbols = [self.inner[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            n = self.merge(symbols)
            self.words.put(word, n)
        return n

    def chunk(self, chunk: str) -> int:
        """Tokens of a text without white space and special strings."""
        n = sum(map(self.word, self.split(chunk)))
        self.chunks.put(chunk, n)
        return n

    def count(self, text: str) -> int:
        total = 0
        if "<|" in text:
            total = len(self.special.findall(text))
            parts = self.special.split(text)
        else:
            parts = [text]
        get, miss = self.chunks.get, self.chunk
        for part in parts:
            for c in _SPLIT.split(part) if _ODD.search(part) else part.split():
                n = get(c)
                total += miss(c) if n is None else n
        return total


@lru_cache(None)
def counter(path: str) -> HeapCounter:
    return HeapCounter(path)


def counts(docs: DataFrame, path: str, limit: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens, over_limit of every row."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in common.sliced(batches):
            texts = b.column(1).to_pylist()
            n = [c.count(x or "") for x in texts]
            size = [len((x or "").encode()) for x in texts]
            yield pa.record_batch([b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["key", "n_bytes", "n_tokens", "over_limit"])

    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes long, n_tokens long, over_limit boolean")
    return got.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(common.read(spark, sf_dir, "documents"), tokenizers_.path("word_bpe_49k.json"), 2048)
