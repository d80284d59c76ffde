"""Token counts by trie-shared dynamic programming over a unigram vocabulary.

The distinct pre-tokens of a batch are put into a trie: in sorted order, each shares a prefix
with the one before, and the path to it is a stack. The best score and token count of every
prefix (the forward pass of unigram segmentation) is computed once, when its node is reached;
a pre-token's count is what stands at its terminal node.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from skyloom.llm.common import CACHE_WORDS, batches, carried, column, ordinary, schema_of

#: Path of a SentencePiece model, a parameter of the query; any vocabulary with pieces will do.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"


@lru_cache(2)
def load_pieces(path: str) -> tuple[dict[str, float], float]:
    """Log score of each ordinary piece, and that of a byte. The file states ranks, not
    probabilities: piece number r gets Zipf's share, -log(r + 2); a byte, of which unknown
    characters are made, is less than the rarest piece."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    pieces = {
        model.id_to_piece(i): -log(i + 2)
        for i in range(size)
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }
    return pieces, -2 * log(size + 2)


class Trie:
    """The path to the pre-token at hand: its characters and, for each prefix, the best score
    (ties: fewer tokens) and the number of tokens of its best segmentation."""

    def __init__(self, pieces: dict[str, float], byte: float):
        self.pieces, self.byte = pieces, byte
        self.longest = max(map(len, pieces), default=1)
        self.word, self.scores, self.tokens = "", [0.0], [0]

    def count(self, word: str) -> int:
        """Tokens of ``word``; only the nodes below the prefix shared with the last word are new."""
        old, scores, tokens, get = self.word, self.scores, self.tokens, self.pieces.get
        shared, most = 0, min(len(old), len(word))
        while shared < most and old[shared] == word[shared]:
            shared += 1
        del scores[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            size = len(word[end - 1].encode("utf-8", "surrogatepass"))
            best, n = scores[end - 1] + size * self.byte, tokens[end - 1] + size
            for start in range(max(0, end - self.longest), end):
                score = get(word[start:end])
                if score is not None:
                    score += scores[start]
                    if score > best or (score == best and tokens[start] + 1 < n):
                        best, n = score, tokens[start] + 1
            scores.append(best)
            tokens.append(n)
        self.word = word
        return tokens[-1]


def count_words(words: Iterable[str], pieces: dict[str, float], byte: float) -> dict[str, int]:
    trie = Trie(pieces, byte)
    return {w: trie.count(SPACE + w) for w in sorted(words)}


def _count(path: str):
    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, byte = load_pieces(path)
        known: dict[str, int] = {}
        for batch in found:
            words, tokens = [], []
            for part in batches(enumerate(column(batch, "text"))):
                split = [t.split() if t else [] for _, t in part]
                if len(known) > CACHE_WORDS:
                    known = {}
                known.update(count_words(set().union(*split).difference(known), pieces, byte))
                words += map(len, split)
                tokens += [sum(map(known.__getitem__, w)) for w in split]
            yield carried(
                batch, ["doc_id"], n_words=pa.array(words, pa.int64()), n_tokens=pa.array(tokens, pa.int64())
            )

    return run


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens for every row of ``documents``: its pre-tokens (runs without
    white space) and the tokens of their best unigram segmentations.

    Null, empty and blank texts have 0 of both. A text of one very long run is one pre-token.
    Repeated rows are counted each; an empty table gives none; other columns are ignored.

    There is no shuffle: documents hold most of their pre-tokens once, so that a shuffle of them
    would move more than the texts. A task keeps the counts of the pre-tokens it has met, up to
    a fixed number of them.
    """
    rows = ordinary(documents, ("doc_id", "text"))
    return rows.mapInArrow(_count(vocabulary), schema_of(rows.select("doc_id"), n_words="long", n_tokens="long"))
