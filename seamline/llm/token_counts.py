"""Token counts: trie-shared dynamic programming over a unigram piece vocabulary.

A pre-token is a word with at most one blank before it, or a run of white space. Pieces come from a public
SentencePiece file; a piece's probability follows Zipf's law by its place in the file, and a character outside every
piece costs one byte token for each UTF-8 byte. The count of a pre-token is that of its most probable segmentation
(among equals, the shortest). Distinct pre-tokens go into a trie; the forward score of a shared prefix is computed
once, and terminal nodes store counts. Each task has its own trie: nothing is shuffled, and a full trie is started
anew, which changes no result.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
PRETOKEN = re.compile(r"▁?[^\s▁]+|[\s▁]+(?=▁[^\s▁])|[\s▁]+")
MAX_NODES = 1_500_000


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """Ordinary pieces in file order; control, unknown and byte pieces are left out."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return [
        sp.id_to_piece(i)
        for i in range(sp.get_piece_size())
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))
    ]


class Trie:
    """Forward scores of prefixes, each computed once."""

    def __init__(self, pieces: list[str], max_nodes: int = MAX_NODES):
        norm = math.log(sum(1 / r for r in range(1, len(pieces) + 1)))
        self.pieces = {p: -math.log(r) - norm for r, p in reversed(list(enumerate(pieces, 1)))}
        self.byte = -math.log(len(pieces) + 1) - norm - math.log(256)
        self.longest, self.max_nodes = max(map(len, pieces), default=1), max_nodes
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[str, int]] = [{}]
        self.score, self.count = [0.0], [0]
        self.terminal: dict[str, int] = {}

    def insert(self, word: str) -> int:
        if len(self.children) > self.max_nodes:
            self.clear()
        node, path = 0, [0]
        for i, ch in enumerate(word, 1):
            after = self.children[node].get(ch)
            if after is None:
                nb = len(ch.encode("utf-8", "surrogatepass"))
                best, n = self.score[node] + nb * self.byte, self.count[node] + nb
                for j in range(max(0, i - self.longest), i):
                    s = self.pieces.get(word[j:i])
                    if s is not None:
                        s, c = s + self.score[path[j]], self.count[path[j]] + 1
                        if s > best or s == best and c < n:
                            best, n = s, c
                after = len(self.children)
                self.children[node][ch] = after
                self.children.append({})
                self.score.append(best)
                self.count.append(n)
            node = after
            path.append(node)
        self.terminal[word] = self.count[node]
        return self.count[node]

    def counts(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of one text."""
        if not text:
            return 0, 0
        words = PRETOKEN.findall("▁" + text.replace(" ", "▁"))
        known = self.terminal
        total, new = 0, {}
        for w in sorted({w for w in words if w not in known}):
            new[w] = self.insert(w)
        known = self.terminal
        for w in words:
            n = known.get(w)
            total += new.get(w) or self.insert(w) if n is None else n
        return len(words), total


def token_counts(docs: DataFrame, pieces: list[str], text: str = "text") -> DataFrame:
    """``docs`` with n_pretokens and n_tokens of the whole text; a null or empty text has none of either."""

    def start():
        trie = Trie(pieces)

        def f(text):
            got = [trie.counts(x or "") for x in text]
            return {"n_pretokens": [g[0] for g in got], "n_tokens": [g[1] for g in got]}

        return f

    return map_rows(docs, {"text": text}, {"n_pretokens": T.LongType(), "n_tokens": T.LongType()}, start)


def op1_token_counts(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, load_pieces(vocabulary)).select("doc_id", "n_pretokens", "n_tokens")
