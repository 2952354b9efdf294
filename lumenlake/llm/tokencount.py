"""Token counts under a unigram vocabulary, by dynamic programming shared along a trie.

The distinct pre-tokens (words with a leading mark) of a batch are put into a trie.  A node's
forward score is that of the best segmentation of the prefix it stands for; it is computed once,
whichever and however many pre-tokens pass through the node, from the scores of its ancestors and
the pieces that end in it.  Terminal nodes store the number of tokens of their pre-token, and a
text's count is the sum over its pre-tokens.

Sorted pre-tokens are the trie in depth-first order, so only the path to the present node is held:
a pre-token goes on from the prefix it shares with the one before.

Pieces are scored by rank (log probability of a Zipf law over the vocabulary's order), which is
what a vocabulary file without probabilities gives; characters without a piece are spelled in
bytes, each one token of a low score.  Of equally good segmentations the one of fewer tokens counts.

Edge cases: null and empty texts and texts of white space only have no tokens; pre-tokens and texts
of any length are processed whole; repeated rows are counted alike; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame

MARK = "▁"
KNOWN_WORDS = 200_000  # per worker: counts that are remembered between batches
BYTE_SCORE = -30.0


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores, and the longest piece's length in characters."""

    scores: dict[str, float]
    longest: int

    @classmethod
    def of(cls, ranked: list[str], zipf_shift: float = 10.0) -> Vocabulary:
        total = math.log(sum(1.0 / (r + zipf_shift) for r in range(len(ranked)))) if ranked else 0.0
        scores: dict[str, float] = {}
        for rank, piece in enumerate(ranked):
            scores.setdefault(piece, -math.log(rank + zipf_shift) - total)
        return cls(scores, max(map(len, ranked), default=0))

    @classmethod
    def from_sentencepiece(cls, path: str) -> Vocabulary:
        """The normal pieces of a sentencepiece model, in the order of their ids."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        special = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        return cls.of([sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not special(i)])


def count_sorted(words: list[str], vocabulary: Vocabulary) -> dict[str, int]:
    """Tokens of each of the sorted distinct pre-tokens, sharing forward scores along the trie."""
    scores, longest = vocabulary.scores, vocabulary.longest
    best: list[float] = [0.0]  # forward score of each prefix on the path from the root
    tokens: list[int] = [0]
    out: dict[str, int] = {}
    before = ""
    for word in words:
        shared = 0
        for a, b in zip(before, word):
            if a != b:
                break
            shared += 1
        del best[shared + 1 :], tokens[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            spelled = len(word[end - 1].encode("utf-8", "surrogatepass"))
            top, n = best[end - 1] + BYTE_SCORE * spelled, tokens[end - 1] + spelled
            for start in range(max(0, end - longest), end):
                piece = scores.get(word[start:end])
                if piece is not None:
                    score = best[start] + piece
                    if score > top or score == top and tokens[start] + 1 < n:
                        top, n = score, tokens[start] + 1
            best.append(top)
            tokens.append(n)
        out[word] = tokens[-1]
        before = word
    return out


def pre_tokens(text: str) -> list[str]:
    return [MARK + w for w in text.split()]


def token_counts(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, n_tokens, n_pretokens) per row of ``docs``; one pass without a shuffle."""
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the vocabulary's pieces

    def run(batches):
        import pyarrow as pa

        known: dict[str, int] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            words = [(t or "").split() for t in texts]
            new = {w for ws in words for w in ws if w not in known}
            fresh = count_sorted(sorted(MARK + w for w in new), shared.value)
            if len(known) + len(fresh) > KNOWN_WORDS:
                new = {w for ws in words for w in ws}
                missing = sorted(MARK + w for w in new if MARK + w not in fresh)
                known = {w: known[w] for w in (m[1:] for m in missing)}
            known.update((w[1:], n) for w, n in fresh.items())
            counts = [sum(map(known.__getitem__, ws)) for ws in words]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(map(len, words), pa.int64())],
                ["doc_id", "n_tokens", "n_pretokens"],
            )

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, n_pretokens long")
