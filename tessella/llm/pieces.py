"""What the tokenizer operators share: a tokenizer file's vocabulary, and the pieces that merges stay within.

The file's path is a parameter. The driver reads the file once and broadcasts its
text, which has the size of a vocabulary; executors need no file.

Pieces of texts whose code points all lie below U+0250 are found with explicit
classes; all other texts go through the library's own normaliser and splitter, so
that no table of character properties but the library's decides there.
"""

from __future__ import annotations

import json
import os
import re
from pathlib import Path

from pyspark import Broadcast
from pyspark.sql import SparkSession

_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_DIGITS = "0-9\xb2\xb3\xb9\xbc-\xbe"
_WHITE = r"\t-\r\x20\x85\xa0"
#: Anything but code points whose classes are stated above; those whose lower case is elsewhere are left to the library too.
_ELSEWHERE = "".join(chr(c) for c in range(0x250) if len(chr(c).lower()) > 1 or chr(c).lower() > "\u024f")
_OTHER = re.compile(f"[^\x00-\u024f]|[{_ELSEWHERE}]")


def is_plain(text: str) -> bool:
    """Whether the classes above hold for every code point; those below U+0100 are told by encoding, which is quick."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _OTHER.search(text) is None
    return True


#: The splitters of the two kinds of file, with the classes above.
_SPLIT = {
    "byte": re.compile(
        f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_WHITE}{_LETTERS}{_DIGITS}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+"
    ),
    "word": re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^{_WHITE}{_LETTERS}{_DIGITS}]+"),
}

#: Pieces remembered by a Python worker, besides as many that were met before, and their longest length in code
#: points: longer ones seldom come again, and a blob without a blank is a piece of its own length.
CACHE, LONGEST = 250_000, 64


def byte_names() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else one from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


NAMES = byte_names()
BYTES = {name: b for b, name in enumerate(NAMES)}
_TO_NAMES = {b: name for b, name in enumerate(NAMES)}


def named(piece: str) -> str:
    """The piece with a character for each of its UTF-8 bytes."""
    return piece.encode().decode("latin-1").translate(_TO_NAMES)


class TokenizerFile:
    """A byte-pair tokenizer file, read for its rules."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        rules = json.loads(text)
        self.vocab: dict[str, int] = rules["model"]["vocab"]
        self.merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in rules["model"]["merges"]]
        self.suffix: str = rules["model"]["end_of_word_suffix"] or ""
        self.kind = "word" if rules["normalizer"] else "byte"
        self.added = {t["content"]: t["id"] for t in rules["added_tokens"]}
        self._at_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self._split = _SPLIT[self.kind]
        if missing := [n for n in NAMES for s in ("", self.suffix) if n + s not in self.vocab]:
            raise ValueError(f"the vocabulary lacks single bytes: {missing[:5]}")

    def segments(self, text: str) -> list[str]:
        """The text cut at the strings of added tokens, which stand at the odd places."""
        return self._at_added.split(text) if self._at_added else [text]

    def pieces(self, segment: str) -> list[str]:
        """The pieces of a text without added tokens."""
        if is_plain(segment):
            return self._split.findall(segment.lower() if self.kind == "word" else segment)
        if self.library.normalizer is not None:
            segment = self.library.normalizer.normalize_str(segment)
        return [bytes(map(BYTES.__getitem__, p)).decode() for p, _ in self.library.pre_tokenizer.pre_tokenize_str(segment)]


def broadcast_file(spark: SparkSession, path: str) -> Broadcast:
    return spark.sparkContext.broadcast(Path(path).read_text())


_open: dict[tuple[type, int], object] = {}


def opened(kind: type, text: str):
    """The worker's own ``kind(text)``, made once."""
    key = (kind, hash(text))
    if key not in _open:
        _open[key] = kind(text)
    return _open[key]


def public_path(name: str) -> str:
    """Where the installed public vocabularies have a file."""
    import public_tokenizers

    return public_tokenizers.path(name)
