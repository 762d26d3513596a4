"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shipping import ship

#: Nodes after which a worker starts a new trie. Only time depends on it.
MAX_NODES = 2_000_000
#: As the library does: how far below the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
SPACE = "▁"
#: A pre-token is a run of spaces with what follows it up to the next space or line break.
PRE_TOKEN = re.compile(r" *[^ \n]+| +|\n")
_MODELS: dict[str, PrefixTrie] = {}


def unigram_pieces(model: str) -> tuple[dict[str, float], bool]:
    """Text pieces with their scores, and whether unknown characters fall back to bytes."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=model)
    ids = range(sp.get_piece_size())
    usable = [i for i in ids if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return {sp.id_to_piece(i): sp.get_score(i) for i in usable}, any(sp.is_byte(i) for i in ids)


class PrefixTrie:
    """Counts by the best segmentation of each distinct pre-token.

    A node is a prefix of pre-tokens seen so far. It holds the forward score, that is the
    best sum of piece scores over all segmentations of the prefix, and the
    number of tokens of the segmentation that has it. Both follow from the nodes
    above, so they are computed once for all pre-tokens that share the prefix.
    Of equal sums the one with the longest last piece counts. An unknown
    character is one token, or with byte fallback as many as it has bytes.
    """

    def __init__(self, scores: dict[str, float], byte_fallback: bool, max_nodes: int = MAX_NODES):
        self.scores, self.byte_fallback, self.max_nodes = scores, byte_fallback, max_nodes
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - UNKNOWN_PENALTY
        self.clear()

    def clear(self) -> None:
        self.children: dict[tuple[int, str], int] = {}
        self.forward = [0.0]
        self.counts = [0]
        self.terminal: dict[str, int] = {}

    def count(self, pre_token: str) -> int:
        """Tokens of ``pre_token``, which is inserted if it is new."""
        found = self.terminal.get(pre_token)
        if found is None:
            if len(self.forward) + len(self.terminal) > self.max_nodes:
                self.clear()
            found = self.terminal[pre_token] = self._insert(pre_token.replace(" ", SPACE))
        return found

    def _insert(self, text: str) -> int:
        node, path = 0, [0]
        for end, char in enumerate(text, 1):
            child = self.children.get((node, char))
            if child is None:
                child = self.children[node, char] = len(self.forward)
                score, count = self._step(text, end, path)
                self.forward.append(score)
                self.counts.append(count)
            node = child
            path.append(node)
        return self.counts[node]

    def _step(self, text: str, end: int, path: list[int]) -> tuple[float, int]:
        best, tokens = None, 0
        for start in range(max(0, end - self.longest), end):
            piece = text[start:end]
            score = self.scores.get(piece)
            width = 1
            if score is None:
                if start != end - 1:
                    continue
                score = self.unknown
                width = len(piece.encode()) if self.byte_fallback else 1
            total = self.forward[path[start]] + score
            if best is None or total > best:
                best, tokens = total, self.counts[path[start]] + width
        return best, tokens


def trie(model: str) -> PrefixTrie:
    if model not in _MODELS:
        _MODELS[model] = PrefixTrie(*unigram_pieces(model))
    return _MODELS[model]


def count_tokens(docs: DataFrame, model: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_chars, n_pretokens, n_tokens for every row of ``docs``.

    The text is taken as it is, with a space put before it, as the pieces expect.
    Null and empty texts have no pre-tokens and no tokens. Each task inserts the pre-tokens of
    its rows into its worker's trie; nothing is shuffled. Null ids and
    repeated rows are kept. Other columns are not read.
    """
    ship(docs.sparkSession)
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = trie(model)
        for batch in batches:
            chars, found, tokens = [], [], []
            for value in batch.column("text"):
                words = PRE_TOKEN.findall(" " + value.as_py()) if value.is_valid and len(value.as_py()) else []
                chars.append(len(value.as_py() or ""))
                found.append(len(words))
                known = counter.terminal.get
                tokens.append(sum(n if (n := known(w)) is not None else counter.count(w) for w in words))
            arrays = [pa.array(x, pa.int64()) for x in (chars, found, tokens)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], names=["doc_id", "n_chars", "n_pretokens", "n_tokens"]
            )

    return docs.mapInArrow(count, f"doc_id {id_type}, n_chars long, n_pretokens long, n_tokens long")
