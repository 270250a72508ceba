"""Token counts of a unigram segmentation, by dynamic programming over a trie of pre-tokens.

Each distinct pre-token (word start mark + word) goes into a trie; the forward score of a node (best sum of piece scores that
spells its path, and the number of pieces of that best way) is computed once, when the node is made, so all words with a
common prefix share it. A word's count is stored at its last node. Ties go to fewer pieces.

A letter in no piece costs as many tokens as its UTF-8 bytes. Null and empty texts have 0 tokens. The trie is kept between
chunks and begun anew at ``MAX_NODES``, which bounds memory and changes no count.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache, partial

from pyspark.sql import DataFrame

from rasterloom.llm.common import WORD, map_text

MARK = "▁"
MAX_NODES = 600_000
#: How much worse than the worst piece a letter in no piece scores.
UNKNOWN = 10.0
words_of = re.compile(WORD).findall


class Trie:
    def __init__(self, pieces: dict[str, float], unknown_scale: bool = True):
        self.score = pieces
        self.most = max(map(len, pieces), default=1)
        self.ends: dict[str, list[int]] = {}
        lengths: dict[str, set[int]] = {}
        for p in pieces:
            lengths.setdefault(p[-1], set()).add(len(p))
        # a piece that ends in this letter can only have one of these lengths
        self.ends = {c: sorted(n) for c, n in lengths.items()}
        self.worst = min(pieces.values(), default=0.0) - UNKNOWN
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best = [0.0]
        self.count = [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        """Tokens of ``word``; makes and scores only the nodes that no earlier word made."""
        child, best, count, score, node, path = self.child, self.best, self.count, self.score, 0, [0]
        for i, c in enumerate(word, 1):
            nxt = child.get((node, c))
            if nxt is None:
                top, n = best[node] + self.worst, count[node] + len(c.encode("utf-8", "surrogatepass"))
                if c in score:
                    top, n = best[node] + score[c], count[node] + 1
                for k in self.ends.get(c, ()):
                    if k > i:
                        break
                    if k > 1 and (s := score.get(word[i - k : i])) is not None:
                        at = path[i - k]
                        t, m = best[at] + s, count[at] + 1
                        if t > top or (t == top and m < n):
                            top, n = t, m
                nxt = len(best)
                child[node, c] = nxt
                best.append(top)
                count.append(n)
            node = nxt
            path.append(node)
        return count[node]

    def counts(self, words: set[str]) -> dict[str, int]:
        """Terminal counts of ``words``, which stay stored for later chunks."""
        for w in sorted(words.difference(self.terminal)):
            if len(self.best) > MAX_NODES:
                self.child, self.best, self.count = {}, [0.0], [0]
            self.terminal[w] = self.insert(MARK + w)
        return self.terminal


@lru_cache(maxsize=4)
def load(path: str) -> Trie:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return Trie({model.id_to_piece(i): model.get_score(i) for i in ids})


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _count(path: str, texts: list[str | None]) -> list:
    trie = load(path)
    words = [words_of(t or "") for t in texts]
    if len(trie.terminal) > MAX_NODES // 2:
        trie.clear()
    known = trie.counts(set().union(*words)) if words else {}
    tally = [Counter(w) for w in words]
    return [[sum([known[w] * n for w, n in c.items()]) for c in tally], [len(w) for w in words], [len(c) for c in tally]]


def token_counts(df: DataFrame, path: str | None = None, column: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``n_pretokens`` and ``n_distinct_pretokens`` (bigint). No shuffle."""
    fields = [("n_tokens", "bigint"), ("n_pretokens", "bigint"), ("n_distinct_pretokens", "bigint")]
    return map_text(df, column, fields, partial(_count, path or default_path()), 1_000_000)
