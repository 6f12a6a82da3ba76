"""Token counts by a linear longest-match automaton.

A trie of the vocabulary carries, for each node, the node where matching goes on
when no edge fits and the number of pieces that leaving the node completes. Greedy
longest-match piece counts then come from one pass over a word's bytes; the pieces
themselves are never built.

Defined cases: a null or blank text has no words and no tokens; a word with a part
that no vocabulary entry covers counts as one token, as word-piece encoders do with
their unknown token. Repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections import Counter, deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import as_bytes, map_columns, table

SCHEMA = T.StructType([
    T.StructField("n_words", T.LongType(), False),
    T.StructField("n_tokens", T.LongType(), False),
    T.StructField("max_word_tokens", T.LongType(), False),
])
#: Vocabularies above this size are refused: the automaton is sent to every executor.
MAX_VOCABULARY_BYTES = 16 << 20


def read_vocabulary(path: str) -> list[bytes]:
    """The entries of a rank file: a base64 entry and its rank on each line."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class LongestMatch:
    """Greedy longest-match piece counts in time linear in a word's length."""

    def __init__(self, vocabulary: list[bytes]) -> None:
        edges: list[dict[int, int]] = [{}]
        final = [False]
        for entry in vocabulary:
            node = 0
            for byte in entry:
                after = edges[node].get(byte)
                if after is None:
                    after = edges[node][byte] = len(edges)
                    edges.append({})
                    final.append(False)
                node = after
            if node:
                final[node] = True
        fall, popped = [-1] * len(edges), [0] * len(edges)
        queue = deque([0])
        while queue:
            above = queue.popleft()
            for byte, node in edges[above].items():
                queue.append(node)
                if final[node]:
                    fall[node], popped[node] = 0, 1
                    continue
                at, count = fall[above], popped[above]
                while at >= 0 and byte not in edges[at]:
                    count += popped[at]
                    at = fall[at]
                if at >= 0:
                    fall[node], popped[node] = edges[at][byte], count
        self.edges, self.fall, self.popped = edges, fall, popped

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; 1 where it has no segmentation; 0 for the empty word."""
        edges, fall, popped = self.edges, self.fall, self.popped
        node = total = 0
        for byte in word:
            after = edges[node].get(byte)
            while after is None:
                total += popped[node]
                node = fall[node]
                if node < 0:
                    return 1
                after = edges[node].get(byte)
            node = after
        while node:
            total += popped[node]
            node = fall[node]
            if node < 0:
                return 1
        return total


def token_counts(df: DataFrame, key: str, text: str, vocabulary: list[bytes], *, cache: int = 200_000) -> DataFrame:
    """One row per row of ``df``: ``key``, n_words, n_tokens, max_word_tokens.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, case kept; each is matched with
    one blank before it. ``cache`` bounds the words whose counts a task remembers.
    """
    size = sum(map(len, vocabulary))
    if size > MAX_VOCABULARY_BYTES:
        raise ValueError(f"the vocabulary has {size} bytes; at most {MAX_VOCABULARY_BYTES} are sent to executors")
    sent = df.sparkSession.sparkContext.broadcast(vocabulary)

    def make():
        match = LongestMatch(sent.value)
        known: dict[bytes, int] = {}

        def fn(texts: pa.Array) -> list[pa.Array]:
            words, tokens, most = [], [], []
            for data in as_bytes(texts):
                counted = Counter(data.split())
                total = longest = 0
                for word, times in counted.items():
                    pieces = known.get(word)
                    if pieces is None:
                        pieces = match.count(b" " + word)
                        if len(word) <= 64:
                            if len(known) >= cache:
                                known.clear()
                            known[word] = pieces
                    total += pieces * times
                    if pieces > longest:
                        longest = pieces
                words.append(counted.total())
                tokens.append(total)
                most.append(longest)
            return [pa.array(x, pa.int64()) for x in (words, tokens, most)]

        return fn

    return map_columns(df, [F.col(key)], [F.col(text)], make, SCHEMA).withColumnRenamed("c0", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocabulary = read_vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", vocabulary)
