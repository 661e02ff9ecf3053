"""Token ids of whole texts, by the ``tokenizers`` library, with a bounded cache of words.

The vocabulary's splitting pattern never matches across white space, its normaliser composes
and lower-cases character by character, and a space is never composed with what follows.
The ids of a text are therefore the ids of its space-separated words, one after another, and
a word's ids can be kept: most words of a corpus are repeats. Splitting is done at the four
plain ASCII spaces only, which every definition of white space contains; a rarer one stays
inside its word and is left to the library.
"""

from __future__ import annotations

import re
from functools import lru_cache
from struct import pack

from tokenizers.pre_tokenizers import ByteLevel

END_ID = 1
CACHE_WORDS = 700_000
CACHE_LETTERS = 64
#: Marks behind a word that the vocabulary's pattern always cuts from the letter or digit before them.
TAIL = ".,!?;:#$%&*|"
#: Letters up to U+00FF: composed, one pre-token in any run, one letter when lowered.
LATIN = "".join(c for c in map(chr, range(256)) if c.isalpha())
#: A full stop or comma right behind a mark belongs to that mark's run. Whatever is neither letter, digit nor blank may be one, control characters too.
_IN_A_RUN = re.compile("[" + re.escape("".join(c for c in map(chr, range(256)) if not c.isalnum() and c != " ")) + "][.,]")


class WordIds:
    """Keeps the bytes of a word's ids (little-endian unsigned 32-bit) once the library has stated them.

    A text of Latin letters and marks is lowered as a whole and its stops and commas are set apart
    first, so that fewer words are told apart. A word that is missing is cut into its body and
    the marks behind it, and what is still missing goes to the library. A body of Latin letters
    alone needs no normaliser and no splitting and is handed to the library's model directly, if
    that is seen to give the same ids. The table is emptied when full, so memory is bounded.
    """

    def __init__(self, tokenizer):
        self._encode, self._model = tokenizer.encode, tokenizer.model
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self._letters = {ord(c): as_bytes(c)[0][0] for c in LATIN}
        trial = [c.lower() + "e" + c.lower() for c in LATIN]
        self._direct = list(map(self._by_model, trial)) == list(map(self._by_library, trial))
        self._words: dict[str, bytes] = {"": b""}

    def encode(self, text: str | None, end_id: int | None = END_ID) -> bytes:
        """The ids of ``text`` (null: empty) and ``end_id`` behind them, as little-endian unsigned 32-bit integers."""
        end = b"" if end_id is None else int(end_id).to_bytes(4, "little")
        if not text:
            return end
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        if self._direct and _up_to_latin(text):
            text = text.lower()
            if not _IN_A_RUN.search(text):
                text = text.replace(". ", " . ").replace(", ", " , ")
        words = text.split(" ")
        found = list(map(self._words.get, words))
        if None in found:
            new = {w: self._state(w) for w in {w for w, b in zip(words, found) if b is None}}
            found = [new[w] if b is None else b for w, b in zip(words, found)]
        return b"".join(found) + end

    def _state(self, word: str) -> bytes:
        body = word.rstrip(TAIL)
        if body != word and body and body[-1].isalnum() and len(body[-1].lower()) == 1:  # some capitals end in a mark when lowered
            ids = self._part(body) + self._part(word[len(body) :])
        else:
            ids = self._part(word)
        self._keep(word, ids)
        return ids

    def _part(self, part: str) -> bytes:
        ids = self._words.get(part)
        if ids is None:
            ids = self._by_model(part.lower()) if self._direct and part.isalpha() and _up_to_latin(part) else self._by_library(part)
            self._keep(part, ids)
        return ids

    def _keep(self, word: str, ids: bytes) -> None:
        if len(self._words) >= CACHE_WORDS:
            self._words = {"": b""}
        if len(word) <= CACHE_LETTERS:  # one-off long strings are not worth their memory
            self._words[word] = ids

    def _by_model(self, part: str) -> bytes:
        return _as_bytes([t.id for t in self._model.tokenize(part.translate(self._letters))])

    def _by_library(self, part: str) -> bytes:
        return _as_bytes(self._encode(part, add_special_tokens=False).ids)


def _up_to_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _as_bytes(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=4)
def word_ids(vocabulary: str) -> WordIds:
    """The cache of this worker process for the vocabulary file ``vocabulary``."""
    from tokenizers import Tokenizer

    return WordIds(Tokenizer.from_file(vocabulary))
