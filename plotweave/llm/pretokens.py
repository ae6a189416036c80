"""When and how texts may be cut into pre-tokens that are encoded one by one, with the ids of the whole text.

Only a byte-level BPE file without normaliser, prefix space, word affixes, dropout or fusing is
`plain`: there each pre-token goes through the merges on its own. Two kinds of text are left to the
library even then: those that hold the content of an added token, which is found before the cut,
and those with code points that Unicode 15.1 has not assigned, which the library's tables and
those of `regex` may class differently (on all others they agree; tested). None of those is white
space, so what lies between blanks can be left to the library alone.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

#: The pre-tokens of the byte-level BPE (fixed value of the tokenizer's file).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def is_plain(path: str) -> bool:
    """Whether the file's texts may be encoded pre-token by pre-token."""
    if not path.endswith(".json"):
        return False
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    cut, model = file.get("pre_tokenizer") or {}, file.get("model") or {}
    return (
        file.get("normalizer") is None
        and cut.get("type") == "ByteLevel"
        and not cut.get("add_prefix_space")
        and cut.get("use_regex", True)
        and model.get("type") == "BPE"
        and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "unk_token", "fuse_unk", "byte_fallback"))
        and all(not (t.get("lstrip") or t.get("rstrip") or t.get("single_word")) for t in file.get("added_tokens") or [])
    )


def byte_signs() -> dict[int, str]:
    """The character that stands for each byte: itself where it is printable, else the next one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


BYTE_SIGNS = byte_signs()


def as_signs(pre_token: str) -> str:
    """A pre-token as the byte-level step hands it to the merges."""
    return pre_token.encode().decode("latin-1").translate(BYTE_SIGNS)


@lru_cache(maxsize=1)
def unassigned():
    """Searches a text for code points without a class."""
    ranges, start = [], None
    for c in range(0x110001):
        if c < 0x110000 and unicodedata.category(chr(c)) == "Cn":
            start = c if start is None else start
        elif start is not None:
            ranges.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return re.compile(f"[{''.join(ranges)}]").search


#: Blocks without unassigned code points that most texts keep to: Latin, Cyrillic, dashes and quotes, kana, the older ideographs.
FAMILIAR = re.compile("[^\x00-\u024f\u0400-\u052f\u2010-\u2027\u3041-\u3096\u4e00-\u9fff]")


class Cutter:
    """Tells texts that may be cut from those the library has to see whole."""

    def __init__(self, tokenizer):
        import regex

        self.added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self.pre_tokens = regex.compile(PRE_TOKEN).findall
        self.unassigned = unassigned()

    def holds_added(self, text: str) -> bool:
        return any(x in text for x in self.added)

    def classed(self, text: str) -> bool:
        """Whether both tables of classes know all of a text's code points."""
        return text.isascii() or FAMILIAR.search(text) is None or self.unassigned(text) is None

    def whole(self, text: str) -> bool:
        return self.holds_added(text) or not self.classed(text)
