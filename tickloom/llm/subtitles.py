"""Reading subtitle files: encodings, cues, and words in a form that recognition errors leave alone."""

from __future__ import annotations

import re
import unicodedata

#: A word starts with a letter, or with digits that a letter follows; cue numbers and times have none.
WORD = re.compile(r"[^\W\d_]\w*|\d+[^\W\d_]\w*")
_TAG = re.compile(r"<[^<>]*>|\{[^{}]*\}")
_WRONG = re.compile(r"[Â-Å][^\x00-\x7f]|â[^\x00-\x7f]{2}")

# Characters that recognition takes for one another, each written out as the common shape: h and li, u and ii, m and rn,
# w and vv, l, i and 1, e and c, o and 0, s and 5, t and f.
_SHAPES = {"h": "ii", "u": "ii", "m": "rn", "w": "vv", "l": "i", "1": "i", "e": "c", "0": "o", "5": "s", "f": "t", "_": ""}


#: Stands for a character that was lost in decoding; a letter, so that it stays inside its word.
UNREADABLE = "ǂ"


def _redecoded(m: re.Match) -> str:
    for encoding in ("cp1252", "latin-1"):
        try:
            return m[0].encode(encoding).decode("utf-8")
        except UnicodeError:
            pass
    # A mixture of both, as when C1 bytes were kept.
    try:
        return b"".join(c.encode("latin-1") if ord(c) < 256 else c.encode("cp1252") for c in m[0]).decode("utf-8")
    except UnicodeError:
        return m[0]


def repaired(text: str) -> str:
    """Text whose UTF-8 bytes were read in a one-byte encoding, once or several times, read properly; other text as it is."""
    for _ in range(3):
        if not _WRONG.search(text):
            break
        text = _WRONG.sub(_redecoded, text)
    return text


def shape(word: str) -> str:
    """The word's canonical shape: without accents, look-alike characters made alike."""
    if not word.isascii():
        word = unicodedata.normalize("NFKD", word.replace("ß", "ss").replace("œ", "oe").replace("æ", "ae"))
        word = "".join(c for c in word if not unicodedata.combining(c))
    return "".join(_SHAPES.get(c, c) for c in word)


def words(text: str) -> list[str]:
    """The words of cue texts and of everything else that isn't a number, a time or a tag, in lower case."""
    if "<" in text or "{" in text:
        text = _TAG.sub(" ", text)
    return WORD.findall(repaired(text).replace("\ufffd", UNREADABLE).lower())


class Shapes(dict):
    """Memo of a function of words; emptied when full, as a corpus may have any number of words."""

    def __init__(self, of, most: int = 300_000):
        super().__init__()
        self.of, self.most = of, most

    def __missing__(self, word: str):
        if len(self) >= self.most:
            self.clear()
        found = self[word] = self.of(word)
        return found
