"""Cutting texts where a byte-level BPE tokenizer surely starts a new word.

The splitting pattern below lets a space stand only at the start of a word or
inside a run of white space that is not followed by a word. A space before a
non-space character therefore always starts a new word, and the pieces between
such spaces are split independently of each other: the words of a text are
the words of its pieces. Pieces repeat much more than texts, so their ids are
kept in a bounded cache.
"""

from __future__ import annotations

import re

from quire.llm.common import ship

ship(__name__)

# Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# Fixed value, measured: ranges that the splitting library of the installed
# version counts as letters or numbers and the tokenizers library does not yet.
NEWER = (
    "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d "
    "107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f "
    "12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff3 16ff4-16ff6 187f8-187ff "
    "18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 "
    "1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 "
    "1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
).split()


def without_newer(pattern: str) -> str:
    """``pattern`` with the NEWER ranges taken out of its letters and numbers."""
    newer = "[" + "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in NEWER) + "]"
    return (pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||{newer}]")
            .replace(r" ?\p{L}", rf" ?[\p{{L}}--{newer}]").replace(r" ?\p{N}", rf" ?[\p{{N}}--{newer}]"))


_ODD = re.compile(r" (?=\s|\Z)")
_CUT = re.compile(r" (?=\S)")


def pieces(text: str) -> list[str]:
    """Cut ``text`` before every space that a non-space character follows.
    Python's ``\\s`` holds all white space of the pattern, so a doubtful place
    is left uncut. The pieces concatenate to the text."""
    if "\x00" not in text and not _ODD.search(text):
        return text.replace(" ", "\x00 ").split("\x00")
    cuts = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
    return [text[a:b] for a, b in zip(cuts, cuts[1:])]


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte in byte-level vocabulary
    files: printable Latin-1 characters stand for themselves, the others take
    the code points from 256 on, in byte order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
