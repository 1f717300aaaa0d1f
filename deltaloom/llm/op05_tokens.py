"""Token counts by dynamic programming over a trie of pre-tokens.

A pre-token is a white-space word with the mark U+2581 before it.  Its best segmentation under a unigram model
(pieces with log-probabilities) is found by forward scores: best(i) = max over pieces ending at i of best(i - len) +
score.  best at a trie node depends on the path to it only, so it is computed once for all pre-tokens that share the
prefix; a terminal stores its number of tokens.  Distinct pre-tokens of a batch are inserted in sorted order,
which is the trie's depth-first order, so only the current path is held.  Characters that no piece covers cost
their UTF-8 bytes, one token each.

The public vocabularies have no unigram model, and tokenizers aren't trained here.  The pieces of a file in its order
get Zipf's probabilities, 1 / rank over their sum; the counts are those of this unigram model, not of the file's own merges.

Nothing is shuffled: each task counts its own texts, with a bounded memory of known words.  Words over LONG characters
take no part in the trie and aren't remembered; long texts are read in blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from deltaloom.llm.textvec import chunks

MARK = "▁"
#: Words whose counts a worker remembers; when full it starts anew.
MEMORY = 400_000
#: Characters of a word that the trie holds, and of a block of a text.
LONG, BLOCK = 128, 1 << 22
#: What a byte costs below the worst piece.
BYTE_COST = 10.0


def pieces(path: str) -> dict[str, float]:
    """Pieces of a sentencepiece model file, without control, unknown and byte pieces, and their unigram scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return zipf([
        model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


def zipf(ranked: list[str]) -> dict[str, float]:
    """Log-probabilities in proportion to 1 / rank."""
    total = math.log(sum(1 / r for r in range(1, len(ranked) + 1))) if ranked else 0.0
    return {piece: -math.log(r) - total for r, piece in enumerate(ranked, 1)}


class TrieCounter:
    """Counts tokens of pre-tokens given in sorted order."""

    def __init__(self, scores: dict[str, float]):
        self.unknown = min(scores.values(), default=0.0) - BYTE_COST
        self.root: dict = {}
        for piece, score in scores.items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = score

    def _next(self, state: tuple[float, int, list], c: str) -> tuple[float, int, list]:
        """Best score, its tokens and the pieces that go on, one character further."""
        score, tokens, open_ = state
        cost = len(c.encode())
        best, least = score + self.unknown * cost, tokens + cost
        still = []
        for node, s, t in (*open_, (self.root, score, tokens)):
            node = node.get(c)
            if node is not None:
                still.append((node, s, t))
                end = node.get("")
                if end is not None:
                    z = s + end
                    if z > best or (z == best and t + 1 < least):
                        best, least = z, t + 1
        return best, least, still

    def count(self, ordered: list[str]) -> list[int]:
        """Number of tokens of each; ties of the score go to fewer tokens."""
        # path[d]: best score and tokens of the prefix of d characters, and the pieces begun before it
        path: list[tuple[float, int, list]] = [(0.0, 0, [])]
        out, before = [], ""
        for word in ordered:
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del path[same + 1:]
            for c in word[same:]:
                path.append(self._next(path[-1], c))
            out.append(path[-1][1])
            before = word
        return out

    def count_long(self, word: str) -> int:
        """Number of tokens of one word, holding no more than the pieces that go on."""
        state: tuple[float, int, list] = (0.0, 0, [])
        for c in word:
            state = self._next(state, c)
        return state[1]


def blocks(text: str) -> Iterator[str]:
    """The text in parts of about BLOCK characters that no word crosses; a longer word makes a longer part."""
    at = 0
    while at < len(text):
        end = min(at + BLOCK, len(text))
        while end < len(text) and not text[end].isspace():
            end += 1
        yield text[at:end]
        at = end


def count_tokens(docs: DataFrame, scores: dict[str, float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, n_tokens for each row of docs; null and empty texts have 0 of both.

    scores (a vocabulary: its size is fixed by the model file) travels with the tasks.  Repeated rows give
    repeated results; an empty relation gives an empty one; other columns of docs are left out.
    """

    def run(batches):
        counter, known = TrieCounter(scores), {}

        def counted(words: list[str]) -> int:
            seen = set(words)
            long = [w for w in seen if len(w) > LONG]
            seen.difference_update(long)
            if len(known) + len(seen) > MEMORY:
                known.clear()
            new = sorted(seen.difference(known))
            known.update(zip(new, counter.count([MARK + w for w in new])))
            if not long:
                return sum(map(known.__getitem__, words))
            extra = {w: counter.count_long(MARK + w) for w in long}
            return sum(extra[w] if w in extra else known[w] for w in words)

        def one(value: str) -> tuple[int, int]:
            parts = [(len(words), counted(words)) for words in (b.split() for b in blocks(value))]
            return sum(n for n, _ in parts), sum(t for _, t in parts)

        for part, texts in chunks(batches, 1, 1 << 22):
            values = [x.decode("utf-8", "replace") for x in texts]
            if sum(map(len, values)) <= 2 * BLOCK:  # all words of the run at once
                lists = [v.split() for v in values]
                counted([w for w in set().union(*lists) if len(w) <= LONG])
                rows = [(len(words), counted_known(words, known, counter)) for words in lists]
            else:
                rows = [one(v) for v in values]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([t for _, t in rows], pa.int64())], names=[key, "n_words", "n_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"{key} {kind}, n_words bigint, n_tokens bigint")


def counted_known(words: list[str], known: dict[str, int], counter: TrieCounter) -> int:
    """Tokens of words of which all but the long ones are known."""
    return sum(known[w] if w in known else counter.count_long(MARK + w) for w in words)


def brute_force(word: str, scores: dict[str, float]) -> int:
    """Tokens of one pre-token by plain forward scores; for tests."""
    unknown = min(scores.values(), default=0.0) - BYTE_COST
    best = [(0.0, 0)]
    for i in range(1, len(word) + 1):
        cost = len(word[i - 1].encode())
        options = [(best[i - 1][0] + unknown * cost, -(-best[i - 1][1] + cost))]
        options += [(best[j][0] + scores[word[j:i]], best[j][1] - 1) for j in range(i) if word[j:i] in scores]
        best.append(max(options))
    return -best[-1][1]


__all__ = ["TrieCounter", "brute_force", "count_tokens", "pieces"]
