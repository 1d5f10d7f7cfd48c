"""Token counts by byte-pair merging with a heap over a linked list; no identifier is made.

The vocabulary's scores rank the merges. A text's count is its initial symbols less its merges, plus
the extra bytes of symbols that the vocabulary lacks. Where no piece of the vocabulary joins a space
mark to characters before it, texts fall apart into words at the marks, and equal words of a batch are
merged once.

Defined results: null and empty texts have 0 tokens; null ids and repeated rows give one row each; an
empty table gives an empty result; columns that are not named are ignored.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import repeat
from operator import add

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import bound_batches

MARK = "▁"
#: Words whose counts a task remembers; it starts anew beyond that.
REMEMBERED = 1_000_000


class Pieces:
    """Pieces with their scores, read from a sentencepiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                score[model.id_to_piece(i)] = model.get_score(i)
        order = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = {p: order[x] for p, x in score.items()}
        self.none = len(order)
        self.known = {p for p in score if len(p) == 1}
        #: Neighbours that stand together in some piece: words fall apart everywhere else.
        self.joint = {p[i : i + 2] for p in score for i in range(len(p) - 1)}
        self.parted = not any(a != MARK and b == MARK for a, b in self.joint)
        self.memory: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of a run of symbols: pop the best adjacent pair, leftmost among equals, until none is left."""
        n, none, rank = len(word), self.none, self.rank.get
        bits = n.bit_length()
        mask = (1 << bits) - 1
        now = list(map(rank, map(add, word, word[1:]), repeat(none)))  # rank of the pair that begins at i
        heap = [r << bits | i for i, r in enumerate(now) if r < none]
        if not heap:
            return n
        heapify(heap)
        now.append(none)
        symbols, left, right = list(word), list(range(-1, n - 1)), list(range(1, n + 1))
        merges = 0
        while heap:
            entry = heappop(heap)
            i = entry & mask
            if now[i] != entry >> bits:
                continue
            merges += 1
            j = right[i]
            symbols[i] = pair = symbols[i] + symbols[j]
            now[j] = none
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                now[i] = r = rank(pair + symbols[k], none)
                if r < none:
                    heappush(heap, r << bits | i)
            else:
                now[i] = none
            h = left[i]
            if h >= 0:
                now[h] = r = rank(symbols[h] + pair, none)
                if r < none:
                    heappush(heap, r << bits | h)
        return n - merges

    def apart(self, word: str) -> int:
        """Tokens of a word: the sum over its stretches of neighbours that some piece holds together."""
        total = 0 if self.known.issuperset(word) else sum(len(c.encode("utf-8", "surrogatepass")) - 1 for c in word if c not in self.known)
        pairs = list(map(add, word, word[1:]))
        if self.joint.issuperset(pairs):
            return total + self.merged(word)
        start = 0
        for i, pair in enumerate(pairs, 1):
            if pair not in self.joint:
                total += self.remembered(word[start:i])
                start = i
        return total + self.remembered(word[start:])

    def remembered(self, stretch: str) -> int:
        if len(stretch) == 1:
            return 1
        found = self.memory.get(stretch)
        if found is None:
            found = self.merged(stretch)
            if len(stretch) <= 64:
                self.memory[stretch] = found
        return found

    def count(self, text: str) -> int:
        if not text:
            return 0
        text = MARK + text.replace(" ", MARK)
        if not self.parted:
            return self.apart(text)
        total, memory = 0, self.memory
        if len(memory) >= REMEMBERED:
            memory.clear()
        for word, times in Counter(re.findall(f"{MARK}+[^{MARK}]*", text)).items():
            found = memory.get(word)
            if found is None:
                found = self.apart(word)
                if len(word) <= 64:
                    memory[word] = found
            total += times * found
        return total


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def token_counts(docs: DataFrame, model: str | None = None, limit: int = 4096) -> DataFrame:
    """docs(doc_id, text) -> n_bytes (UTF-8), n_tokens and over_limit. model: path of the vocabulary on every machine."""

    bound_batches(docs.sparkSession)

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = Pieces(os.fspath(model or default_model()))
        for f in frames:
            texts = [t if isinstance(t, str) else "" for t in f["text"]]
            tokens = [pieces.count(t) for t in texts]
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_bytes": [len(t.encode("utf-8", "surrogatepass")) for t in texts], "n_tokens": tokens, "over_limit": [n > limit for n in tokens]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInPandas(counted, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
