"""Public byte-level BPE ids, and token counts under a unigram model by dynamic programming on a trie.

`byte_bpe` gives the ids of the `tokenizers` file. The same vocabulary as ranks (a `.tiktoken` file beside it) encodes
several times faster; it is used for texts of characters on which both libraries' patterns agree (ASCII, Latin letters
and general punctuation), the `tokenizers` file itself for all others and for texts with a special token's string.

`count_tokens` counts the pieces of the best unigram segmentation of every text. A text is split at white space into
pre-tokens. The distinct pre-tokens of a slice form a trie; each trie node holds the best forward score (and its number
of pieces) of the prefix it stands for, computed once however many pre-tokens share the prefix; terminal nodes hold
the count of a pre-token. A piece's log-probability follows Zipf's law on its rank in the public vocabulary, as that
file has no unigram scores. Unknown characters cost one piece for each UTF-8 byte.

Defined results: null and empty texts count 0; texts and words of any length are counted whole; equal scores prefer fewer
pieces; every row counts by itself, whatever its id.
"""

from __future__ import annotations

import base64
import math
import os
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from .common import map_columns, pruned

_encoders: dict[str, Callable[[str], list[int]]] = {}
# Fixed value: the public tokenizer's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_UNSURE = re.compile("[\x1c-\x1f\x85\xa0\u0250-\u200f\u2028-\U0010ffff]|<\\|")


def byte_bpe(path: str) -> Callable[[str], list[int]]:
    """text -> ids of the byte-level BPE in a tokenizers JSON file, no special tokens added."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(path)
        ranks = os.path.splitext(path)[0] + ".tiktoken"
        if os.path.exists(ranks):
            import tiktoken

            with open(ranks, "rb") as f:
                pairs = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=pairs, special_tokens={}).encode_ordinary
            _encoders[path] = lambda text: exact.encode(text, add_special_tokens=False).ids if _UNSURE.search(text) else fast(text)
        else:
            _encoders[path] = lambda text: exact.encode(text, add_special_tokens=False).ids
    return _encoders[path]


def unigram_pieces(model_path: str) -> dict[str, float]:
    """Log-probabilities by Zipf's law on the rank of each ordinary piece of a public sentencepiece file."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    norm = math.log(sum(1.0 / (r + 10) for r in range(len(names))))
    return {name: -math.log(r + 10) - norm for r, name in enumerate(names)}


class UnigramTrie:
    """Piece counts of best segmentations: a trie of pre-tokens whose nodes hold forward scores, computed once per prefix."""

    BYTE = -16.0
    MARK = "\u2581"  # how the public vocabulary writes the space before a word

    DEEP = 256  # pre-tokens with more characters are scored without nodes, from the states that a piece can reach back to

    def __init__(self, pieces: dict[str, float]):
        self.longest = max(map(len, pieces), default=1)
        self.pieces: dict = {}  # reversed: a node's score is under ""
        for piece, score in pieces.items():
            node = self.pieces
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.clear()

    def clear(self) -> None:
        """Forget all pre-tokens."""
        # a node: children by character, best score up to here, its number of pieces, and that number again where a pre-token ends
        self.root, self.nodes = [{}, 0.0, 0, None], 1

    def _forward(self, states: list, base: int, word: str, end: int) -> tuple[float, int]:
        """Best score and number of pieces of word[:end], from the states [.., score, pieces, ..] of word[:base], word[:base + 1] and so on."""
        node, at, top = self.pieces, end, None
        while at > base and (node := node.get(word[at - 1])) is not None:
            at -= 1
            if "" in node:
                state = states[at - base]
                here = (state[1] + node[""], -state[2] - 1)
                if top is None or here > top:
                    top = here
        width, state = len(word[end - 1].encode("utf-8", "surrogatepass")), states[end - 1 - base]
        spelled = (state[1] + self.BYTE * width, -state[2] - width)
        if top is None or spelled > top:
            top = spelled
        return top[0], -top[1]

    def insert(self, pretoken: str) -> int:
        """Put a pre-token into the trie; its number of pieces, which stays at its last node."""
        word = self.MARK + pretoken
        if len(word) > self.DEEP:
            return self._unshared(word)
        node, path = self.root, [self.root]
        for end, c in enumerate(word, 1):
            below = node[0].get(c)
            if below is None:
                below = node[0][c] = [{}, *self._forward(path, 0, word, end), None]
                self.nodes += 1
            node = below
            path.append(node)
        if node[3] is None:
            node[3] = node[2]
        return node[3]

    def _unshared(self, word: str) -> int:
        states, base = [(None, 0.0, 0)], 0
        for end in range(1, len(word) + 1):
            states.append((None, *self._forward(states, base, word, end)))
            if len(states) > 4 * self.longest:
                base += len(states) - self.longest
                del states[: -self.longest]
        return states[-1][2]

    def counts(self, pretokens: list[str]) -> dict[str, int]:
        """Number of pieces of each pre-token."""
        return {w: self.insert(w) for w in pretokens}


_tries: dict[str, UnigramTrie] = {}


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", remembered: int = 400_000) -> DataFrame:
    """One row per document: the id, its number of pre-tokens and of tokens; rows that share an id, or have none, each count.

    `remembered` bounds the trie nodes and the counts that a worker keeps between slices; it changes the work, not results.
    """
    known: dict[str, int] = {}

    def run(ids, texts):
        trie = _tries.get(model_path) or _tries.setdefault(model_path, UnigramTrie(unigram_pieces(model_path)))
        words = [t.split() if t else [] for t in texts]
        fresh = set().union(*words) - known.keys()
        if len(known) + len(fresh) > remembered or trie.nodes > 2 * remembered:
            known.clear()
            trie.clear()
            fresh = set().union(*words)
        known.update(trie.counts(list(fresh)))
        get = known.__getitem__
        return ids, [len(w) for w in words], [sum(map(get, w)) for w in words]

    return map_columns(pruned(docs, id=id_col, text=text_col), run, f"{id_col} {dict(docs.dtypes)[id_col]}, n_pretokens bigint, n_tokens bigint", rows=512)
