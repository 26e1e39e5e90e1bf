"""BPE encoding by dynamic programming over the prefixes of a word.

Every prefix of a word has exactly one last token in its BPE encoding. An Aho-Corasick automaton of the vocabulary
finds the tokens that are suffixes of a prefix; the right one is the token that is compatible with the last
token of the prefix before it. Following these back from the end of the word gives the exact token ids, without
running any merges. Two tokens are compatible if no merge would have joined them across their border.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import ahocorasick
import regex
from pyspark.sql import DataFrame

from linkspark.llm.tables import per_text

# The word pattern, the white space and the byte alphabet of the vocabulary format.
SPACE = r"\t-\r \x85" + "".join(map(chr, (0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
ASCII_WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t-\r 0-9a-z]+")
END = "</w>"

#: Added to the character that ends a word.
LAST = 0x1000
#: Words of which a worker remembers the encoding; beyond it the memory starts anew.
REMEMBERED = 300_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


class Vocabulary:
    """Tokens, merge ranks and the automaton of a word-end BPE vocabulary."""

    def __init__(self, content: str):
        spec = json.loads(content)
        self.names = {i: t for t, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.splits = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        ids = spec["model"]["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(spec["model"]["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            whole, pair = ids[left + right], (ids[left], ids[right])
            self.pairs.setdefault(pair, rank)
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = pair, rank
        self.right: dict[int, list[tuple[int, float]]] = {}
        self.left: dict[int, list[tuple[int, float]]] = {}
        self.known: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ids.items():
            if self.reachable(i):
                body, ended = (token[: -len(END)], True) if token.endswith(END) and token != END else (token, False)
                letters = body[:-1] + chr(ord(body[-1]) + LAST) if ended else body
                self.automaton.add_word(letters, (i, len(letters)))
        self.automaton.make_automaton()
        self.letters = byte_letters()

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces at one edge while ``token`` is being built, each with the rank at which it is absorbed."""
        memory = self.right if side else self.left
        out = memory.get(token)
        if out is None:
            out = memory[token] = [(token, float("inf"))]
            while token in self.parts:
                until, token = self.rank[token], self.parts[token][side]
                out.append((token, until))
        return out

    def crosses(self, a: int, b: int, but: tuple[int, int] | None = None) -> bool:
        """Some merge joins a piece of ``a`` with a piece of ``b``. Of equal merges the one on the left goes first."""
        for x, until_x in self.edge(a, 1):
            for y, until_y in self.edge(b, 0):
                rank = self.pairs.get((x, y))
                if rank is not None and rank < until_x and rank <= until_y and (x, y) != but:
                    return True
        return False

    def reachable(self, token: int) -> bool:
        """The merges turn the token's own text into the token."""
        if token not in self.parts:
            return True
        a, b = self.parts[token]
        return not self.crosses(a, b, (a, b)) and self.reachable(a) and self.reachable(b)

    def compatible(self, a: int, b: int) -> bool:
        found = self.known.get((a, b))
        if found is None:
            if len(self.known) > 1_000_000:
                self.known.clear()
            found = self.known[a, b] = not self.crosses(a, b)
        return found

    def encode_word(self, word: str) -> list[int]:
        """Token ids of one word, already normalised."""
        text = "".join([self.letters[b] for b in word.encode()])
        text = text[:-1] + chr(ord(text[-1]) + LAST)
        last: list[tuple[int, int] | None] = [None] * (len(text) + 1)  # of each prefix: its last token and length
        for end, (token, n) in self.automaton.iter(text):
            end += 1
            if last[end] is None:
                if n == end or (last[end - n] is not None and self.compatible(last[end - n][0], token)):
                    last[end] = (token, n)
        out, at = [], len(text)
        while at:
            token, n = last[at]
            out.append(token)
            at -= n
        return out[::-1]

    def words(self, text: str) -> list[str]:
        """Normalised words; special tokens stay whole."""
        out: list[str] = []
        for i, piece in enumerate(self.splits.split(text)) if "<|" in text else [(0, text)]:
            if i % 2:
                out.append(piece)
            elif piece.isascii():
                out += ASCII_WORD.findall(piece.lower())
            else:
                # lower case letter by letter: no final form of sigma
                out += WORD.findall(unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower())
        return out

    def encode(self, text: str) -> list[int]:
        return [i for w in self.words(text) for i in ([self.special[w]] if w in self.special else self.encode_word(w))]

    def decode(self, ids: list[int]) -> str:
        """Token names joined by a space, special tokens included: this vocabulary has no decoder."""
        return " ".join([self.names[i] for i in ids])


class Encoded(dict):
    """Of each word: its ids as text and what they decode to."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> tuple[str, str]:
        v = self.vocabulary
        ids = [v.special[word]] if word in v.special else v.encode_word(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = (" ".join(map(str, ids)), v.decode(ids))
        return out


class Shared:
    """A vocabulary file as it is sent to the workers, which build the vocabulary once.

    What a worker builds and remembers lasts as long as the broadcast does there: it goes when the worker turns to other work.
    """

    def __init__(self, content: str):
        self.content = content
        self.built: tuple[Vocabulary, Encoded] | None = None

    def __getstate__(self):
        return {"content": self.content, "built": None}

    def loaded(self) -> tuple[Vocabulary, Encoded]:
        if self.built is None:
            vocabulary = Vocabulary(self.content)
            self.built = vocabulary, Encoded(vocabulary)
        return self.built


def _content(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` and ``ids``, the token ids of each whole text; null and empty texts have none."""
    shared = docs.sparkSession.sparkContext.broadcast(Shared(_content(path)))

    def run(texts):
        vocabulary, _ = shared.value.loaded()
        return [(vocabulary.encode(t or ""),) for t in texts]

    return per_text(docs, keep, "ids array<int>", run, text)


def digests(docs: DataFrame, path: str, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, the number of tokens, and SHA-256 of the ids and of the text they decode to.

    Null and empty texts have no tokens and the digests of the empty text. Repeated rows give repeated rows.
    The vocabulary file is read on the driver and sent to the workers.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Shared(_content(path)))

    def run(texts):
        vocabulary, memory = shared.value.loaded()
        out = []
        for t in texts:
            found = [memory[w] for w in vocabulary.words(t or "")]
            ids = " ".join([x[0] for x in found])
            text = " ".join([x[1] for x in found])
            out.append((ids.count(" ") + 1 if ids else 0, _sha(ids), _sha(text)))
        return out

    return per_text(docs, keep, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", run, text)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
