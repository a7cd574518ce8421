"""Bounded cache of what a tokenizer makes of the words between white space.

Every tokenizer used here treats ASCII white space as a border that nothing crosses, so a text's result is the
results of its segments one after another, and each different segment needs to be worked out once.
"""

from __future__ import annotations

import functools
import unicodedata


class SegmentCache:
    """segment (bytes) -> value, two generations of at most `most` entries each; what was used lately stays."""

    def __init__(self, work, most: int = 300_000):
        self.work, self.most, self.young, self.old = work, most, {}, {}

    def load(self, segments: set) -> dict:
        """A dict that holds at least these segments; valid until the next call."""
        if len(self.young) > self.most:
            self.old, self.young = self.young, {}
        missing = segments.difference(self.young)
        if missing and self.old:
            again = {s: self.old[s] for s in missing if s in self.old}
            self.young.update(again)
            missing = missing.difference(again)
        if missing:
            listed = list(missing)
            self.young.update(zip(listed, self.work(listed)))
        return self.young


@functools.cache
def _unassigned() -> frozenset:
    """Letters and digits of the regex module that the tokenizers library's older Unicode tables don't have.

    Both are asked, for the characters that are new enough for Python not to know them either."""
    import regex
    from tokenizers import Regex, pre_tokenizers

    new = [chr(c) for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) == "Cn"]
    new = regex.findall(r"[\p{L}\p{N}]", "".join(new))
    asked = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "isolated")
    return frozenset(c for c in new if len(asked.pre_tokenize_str(f"!{c}!")) == 1)


def pretokens(pattern, text: str) -> list[str]:
    """All matches of a compiled pattern, by the tokenizers library's notion of letters and digits."""
    if not text.isascii() and not _unassigned().isdisjoint(text):
        known = "".join("\ufffd" if c in _unassigned() else c for c in text)
        return [text[m.start() : m.end()] for m in pattern.finditer(known)]
    return pattern.findall(text)


@functools.cache
def _library_normal():
    from tokenizers import normalizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str


def _python_normal(text: str) -> str:
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


@functools.cache
def _unlike() -> set:
    """Characters that the library's Unicode tables reorder or compose otherwise than Python's do."""
    marks = [chr(c) for c in range(0x80, 0x110000) if unicodedata.combining(chr(c))]
    asked = [("q\u0315" + c + "\u0334", c) for c in marks]
    for c in range(0x80, 0x110000):
        parts = unicodedata.decomposition(chr(c))
        if parts and parts[0] != "<":
            whole = "".join(chr(int(x, 16)) for x in parts.split())
            asked.append((whole, whole))
    found = _library_normal()("!".join(a for a, _ in asked)).split("!")
    return {c for (a, own), f in zip(asked, found, strict=True) if f != _python_normal(a) for c in own}


_alike: set = set(map(chr, range(128)))


def normal_form(text: str) -> str:
    """NFC and lower case, each character by itself (no final sigma), by the tables of the tokenizers library.

    Python's own functions serve where they agree with it; each new character is compared once."""
    if text.isascii():
        return text.lower()
    if not _alike.issuperset(text):
        new, unlike = set(text).difference(_alike), _unlike()
        _alike.update(c for c in new if c not in unlike and _library_normal()(c) == _python_normal(c))
        if not _alike.issuperset(text):
            return _library_normal()(text)
    return _python_normal(text)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself if visible in Latin-1, else the next from U+0100 on."""
    visible = set(range(33, 127)) | set(range(161, 173)) | set(range(174, 256))
    spare = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


def split_column(col) -> list[list[bytes]]:
    """As split_texts, from the bytes of a large_string column without nulls."""
    from .common import text_bytes

    raw, ends = text_bytes(col)
    raw, ends = raw.tobytes(), ends.tolist()
    return [raw[a:b].split() for a, b in zip(ends, ends[1:])]


def split_texts(texts: list) -> list[list[bytes]]:
    """Runs of bytes other than space and 09-0D of each text; None is empty."""
    return [t.encode("utf-8", "surrogatepass").split() if t else [] for t in texts]


_held: dict = {}


def cached(key, make) -> SegmentCache:
    """One cache per key in each Python worker, kept between tasks."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]
