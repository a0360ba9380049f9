"""Token counts under a unigram model by dynamic programming over a trie.

A text's pre-tokens are its runs of non-blank characters, each with the word mark in front. The new
distinct pre-tokens of a batch form a trie, walked in sorted order: a node gets its forward score
(the best segmentation of the prefix it stands for) once, whatever number of pre-tokens share it,
and is dropped once its branch is done. Terminal nodes leave their token count in a bounded memo.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.common import id_type, small, table
from kindred.llm.tokens import vocabulary

MARK = "▁"
#: Log probability below the rarest piece's that a character without a piece costs.
UNKNOWN = 10.0
#: Entries of one generation of the memo, two are kept; and bytes of a word above which it isn't remembered.
MEMO, LONGEST = 400_000, 48


class Unigram:
    """Pieces with log probabilities. Characters without a piece are spelt in bytes, a token each."""

    def __init__(self, scores: dict[str, float]):
        self.scores, self.longest = scores, max(map(len, scores), default=1)
        self.rare = min(scores.values(), default=0.0) - UNKNOWN

    @classmethod
    def ranked(cls, pieces: list[str]) -> Unigram:
        """A model of a vocabulary that has ranks only: probabilities fall with rank by the Zipf-Mandelbrot law, p ~ 1 / (rank + 2.7)."""
        total = math.log(sum(1 / (r + 2.7) for r in range(len(pieces))))
        return cls({p: -math.log(r + 2.7) - total for r, p in enumerate(pieces)})

    def counts(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """(word, tokens of its best segmentation); of equally good ones, that whose last piece is longest.

        `words` must be sorted and distinct.
        """
        get, longest = self.scores.get, self.longest
        score, count, prev = [0.0], [0], ""
        for word in words:
            n = 0
            for a, b in zip(prev, word):
                if a != b:
                    break
                n += 1
            del score[n + 1 :], count[n + 1 :]
            for end in range(n + 1, len(word) + 1):
                best, tokens = -math.inf, 0
                for start in range(max(0, end - longest), end):
                    s = get(word[start:end])
                    if s is not None and score[start] + s > best:
                        best, tokens = score[start] + s, count[start] + 1
                if word[end - 1 : end] not in self.scores and score[end - 1] + self.rare > best:
                    best, tokens = score[end - 1] + self.rare, count[end - 1] + len(word[end - 1].encode("utf-8", "replace"))
                score.append(best)
                count.append(tokens)
            yield word, count[-1]
            prev = word


@functools.lru_cache(maxsize=2)
def _model(path: str) -> tuple[Unigram, list[dict[str, int]]]:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ids.sort(key=lambda i: (-sp.get_score(i), i))
    return Unigram.ranked([sp.id_to_piece(i) for i in ids]), [{}, {}]


def count_tokens(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every whole text under the pieces of the sentencepiece file `model`, taken as a unigram model.

    Where the file has ranks and no probabilities, these follow from the ranks by a Zipf law, so counts are those of
    that model and of no tokenizer in use.

    Null and blank texts have 0 tokens. Repeated rows and null ids stay; other columns are ignored; no rows move.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unigram, memo = _model(model)
        for b in small(batches):
            words = [(t.as_py() or b"").split() for t in b.column(1)]
            if len(memo[0]) > MEMO:
                memo[1] = memo[0]
                memo[0] = {}
            young, old = memo
            new = set()
            for w in words:
                new.update(w)
            new.difference_update(young)
            for w in new & old.keys():
                young[w] = old[w]
            names = {MARK + w.decode("utf-8", "replace"): w for w in new if w not in old}
            for word, n in unigram.counts(sorted(names)):
                young[names[word]] = n
            n = np.fromiter((sum(map(young.__getitem__, w)) for w in words), np.int64, len(words))
            for w in new:  # such as whole texts without blanks
                if len(w) > LONGEST:
                    del young[w]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n)], names=["id", "n_tokens"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, f"id {id_type(docs, id_col)}, n_tokens long")


def op5_token_counts(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """Tokens of all documents under the public 32k vocabulary."""
    return count_tokens(table(spark, sf_dir, "documents"), model or vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")
