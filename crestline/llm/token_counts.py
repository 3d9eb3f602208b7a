"""Token counts under a unigram model, by dynamic programming over a trie of distinct words.

The best segmentation of a word's beginning depends on nothing that follows, so
words with a common beginning share its forward scores. A batch's distinct new
words, sorted, are a walk through their trie, depth first: the scores along the
current path stay, and only what a word adds to the path is computed. Counts
are kept at the words' last nodes; a text's count is their sum.
"""

from __future__ import annotations

import math
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.bpe import slices

#: Distinct words that a worker keeps.
KEPT_WORDS = 500_000
#: Fixed value: what stands before a word in the vocabulary file.
WORD_MARK = "▁"


def piece_costs(path: str) -> dict[str, float]:
    """Cost of each ordinary piece of a vocabulary file of the sentencepiece library.

    The file orders its pieces by merges and has no probabilities; a piece's
    place in it counts as its rank under Zipf's law.
    """
    import sentencepiece

    pieces = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = [i for i in range(pieces.get_piece_size()) if not (pieces.is_control(i) or pieces.is_unknown(i) or pieces.is_byte(i) or pieces.is_unused(i))]
    total = math.log(sum(1 / (rank + 1) for rank in range(len(plain))))
    return {pieces.id_to_piece(i): math.log(rank + 1) + total for rank, i in enumerate(plain)}


class PrefixTrie:
    """Forward scores along the path to the current word, and the counts of finished words."""

    def __init__(self, costs: dict[str, float]):
        self.costs = costs
        self.longest = max(map(len, costs), default=1)
        #: A character outside the vocabulary takes a token for each of its bytes, each dearer than any piece.
        self.byte_cost = max(costs.values(), default=0.0) + 10.0
        self.counts: dict[str, int] = {}

    def insert(self, words: list[str]) -> None:
        """Counts the tokens of new words."""
        path, best, tokens = "", [0.0], [0]
        for word in sorted(words):
            shared = len(commonprefix([path, word]))
            del best[shared + 1 :], tokens[shared + 1 :]
            path = word
            for end in range(shared + 1, len(word) + 1):
                n_bytes = len(word[end - 1].encode("utf-8", "surrogatepass"))
                least, count = best[end - 1] + self.byte_cost * n_bytes, tokens[end - 1] + n_bytes
                for start in range(max(0, end - self.longest), end):
                    cost = self.costs.get(word[start:end])
                    if cost is not None and (best[start] + cost, tokens[start] + 1) < (least, count):
                        least, count = best[start] + cost, tokens[start] + 1
                best.append(least)
                tokens.append(count)
            self.counts[word] = tokens[-1]

    def count(self, texts: list[str | None]) -> tuple[list[int], list[int]]:
        """Words and tokens of each text."""
        if len(self.counts) > KEPT_WORDS:
            self.counts.clear()
        cut = [[WORD_MARK + w for w in (t or "").split()] for t in texts]
        self.insert(list({w for words in cut for w in words if w not in self.counts}))
        return [len(words) for words in cut], [int(np.fromiter(map(self.counts.__getitem__, words), dtype=np.int64, count=len(words)).sum()) for words in cut]


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, n_tokens of each row of docs.

    n_tokens is the number of pieces in the cheapest segmentation of the
    text's words, the fewest at equal cost. A null or empty text has none; null
    and repeated ids are counted like others. Rows stay where they are.
    """
    shared = docs.sparkSession.sparkContext.broadcast(piece_costs(path))

    def run(batches):
        trie = PrefixTrie(shared.value)
        for batch in batches:
            for start, texts in slices(batch, 1):
                words, tokens = trie.count(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=["id", "n_words", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_words long, n_tokens long")
