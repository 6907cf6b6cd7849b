"""What a word-end BPE vocabulary file holds, and the text rules around it: special strings, normalising, splitting.

A word is written over an alphabet of 512 symbols: chr(b) for byte b, chr(256 + b) for the last byte of a word. A
token is then a plain string over that alphabet, with or without the word end.
"""

from __future__ import annotations

import json
import re
import unicodedata

import regex

#: White space as the splitting pattern knows it (Unicode White_Space).
SPACE = r"\t\n\v\f\r \x85\xa0  -     　"
_SPLIT_SPACE = regex.compile(f"[{SPACE}]+")
#: Contractions, runs of letters, single numbers, runs of what is neither.
_PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
_ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\v\f\r a-z0-9]+")
#: What str.split() takes for white space and the pattern does not.
_ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Tokens as strings over the 512 symbols, merges in order, special strings; parsed on the driver and broadcast."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model, end = data["model"], data["model"]["end_of_word_suffix"]
        if model["type"] != "BPE" or not end or model.get("continuing_subword_prefix") or data.get("decoder"):
            raise ValueError("only BPE vocabularies with a word-end suffix and without a decoder are known here")
        table = byte_symbols()

        def symbols(token: str) -> str:
            stem = token.removesuffix(end)
            s = "".join(chr(table[c]) for c in stem)
            return s if stem == token else s[:-1] + chr(256 + ord(s[-1]))

        self.written = {i: t for t, i in model["vocab"].items()}
        self.ids = {symbols(t): i for t, i in model["vocab"].items()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"] if t["special"]}
        self.written |= {i: t for t, i in self.special.items()}


# What the library's Unicode 16 tables say otherwise than this Python's (15.1) and the regex module's (newer).
#: Code points that are letters or numbers only in a newer Unicode.
NEWER = regex.compile(
    "[\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
    "\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    "\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    "\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    "\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    "\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    "\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
    "\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f]"
)
#: Lower-case letters that this Python does not know yet, and the capital sigma, which never becomes a final one.
LOWER = (
    {0x1C89: 0x1C8A, 0xA7CB: 0x0264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x019B}
    | {c: c + 0x20 for c in range(0x10D50, 0x10D66)}
    | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
    | {0x03A3: 0x03C3}
)
_LOWER = regex.compile("[" + "".join(map(chr, LOWER)) + "]")


def normalised(text: str) -> str:
    """NFC, then every character lower-cased by itself."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.translate(LOWER) if _LOWER.search(text) else text).lower()


def blocks(text: str) -> list[str]:
    """Parts of ``text`` without white space: a block's tokens do not depend on what is around it."""
    if _ODD_SPACE.search(text) if not text.isprintable() else False:
        return [b for b in _SPLIT_SPACE.split(text) if b]
    return text.split()


def pieces(block: str) -> list[str]:
    """The words of a block."""
    text = normalised(block)
    if text.isascii():
        return [text] if text.isalpha() else _ASCII_PIECES.findall(text)
    if NEWER.search(text):  # these are neither letters nor numbers here
        return [text[m.start() : m.end()] for m in _PIECES.finditer(NEWER.sub("\ue000", text))]
    return _PIECES.findall(text)


def symbols(word: str) -> str:
    """A word as symbols with its end marked."""
    data = word.encode("utf-8", "surrogatepass")
    return data[:-1].decode("latin-1") + chr(256 + data[-1])


class Recent:
    """A bounded table in two halves: when the new half is full it becomes the old one, and what is still asked for moves back."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size // 2, {}, {}

    def get(self, key):
        if (value := self.new.get(key)) is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Specials:
    """Cuts special strings out of a block, before anything else is done to it."""

    def __init__(self, special: dict[str, int]):
        self.ids = special
        self.pattern = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.mark = min(special, key=len)[:1] if special else ""

    def cut(self, block: str) -> list[tuple[str, int | None]]:
        if not self.pattern or self.mark not in block:
            return [(block, None)]
        return [(x, self.ids.get(x)) for x in self.pattern.split(block) if x]
