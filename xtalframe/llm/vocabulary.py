"""The public subword vocabulary that the token operators read."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

SPACE = "▁"
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


class Vocabulary(NamedTuple):
    ids: dict[str, int]  # ordinary pieces
    scores: list[float]
    pieces: list[str]
    bytes: list[int]  # id of each byte's piece
    automaton: object
    characters: frozenset[str]  # those that are pieces by themselves


@lru_cache(maxsize=2)
def load(path: str) -> Vocabulary:
    """Pieces, scores, byte pieces and an automaton over the ordinary pieces;
    once per Python worker."""
    import ahocorasick
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    ids, of_byte = {}, [0] * 256
    automaton = ahocorasick.Automaton()
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            of_byte[int(_BYTE.fullmatch(p)[1], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[p] = i
            automaton.add_word(p, (i, len(p)))
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {p!r} joins two words; texts can't be split at spaces")
    automaton.make_automaton()
    characters = frozenset(p for p in ids if len(p) == 1)
    if not characters.issuperset("".join(ids)):
        raise ValueError("a piece holds a character that is no piece; words can't be split at it")
    return Vocabulary(ids, [sp.get_score(i) for i in range(len(pieces))], pieces, of_byte, automaton, characters)


#: A word with the spaces before it. No piece crosses from a word into the next
#: space, so the words of a text can be tokenized one by one.
CHUNK = re.compile(rf"[ {SPACE}]*[^ {SPACE}]+|[ {SPACE}]+")


def words_of(text: str) -> list[str]:
    """The text's words, each without the one marker that stands before it; more
    markers, which a text has where spaces follow each other, stay."""
    if not text:
        return []
    if text[0] != " " and "  " not in text and SPACE not in text:
        return text.split(" ")
    return [w[1:] for w in CHUNK.findall(" " + text)]


def marked(word: str) -> str:
    """A word of ``words_of`` as pieces spell it."""
    return SPACE + word.replace(" ", SPACE)


class Recent(dict):
    """Results for words seen of late: when ``size`` are kept, the older half
    makes room, but a word asked for again stays. No result is None."""

    def __init__(self, size: int, make=None):
        super().__init__()
        self.half, self.make, self.older = max(1, size // 2), make, {}

    def __missing__(self, word: str):
        found = self.older.pop(word, None)
        if found is None:
            found = self.make(word)
        self.keep(word, found)
        return found

    def held(self, word: str):
        """The result, if it is known."""
        found = self.get(word)
        if found is None and (found := self.older.pop(word, None)) is not None:
            self.keep(word, found)
        return found

    def keep(self, word: str, found) -> None:
        if len(word) > LONG:
            return
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        self[word] = found


#: Longer words are not kept.
LONG = 4096
