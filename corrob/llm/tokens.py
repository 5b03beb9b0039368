"""Texts to token ids by a file of the tokenizers library, at the speed of looking words up.

A byte-level BPE of the usual pattern cuts a text into words, numbers, marks and white space before it joins bytes, so
the ids of a word don't depend on its neighbours. Texts are cut at places where that pattern cuts whatever surrounds
them, and the ids of a part are kept once the library has given them: a worker asks the library for each different
part, not for each part. Files that normalise or cut texts otherwise are found out, and get their texts whole. A very
long text takes memory for its ids and its longest part.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

#: Parts whose ids a worker keeps (as many used before stay until the next are full), and the longest of them.
KEPT_PARTS, KEPT_LENGTH = 600_000, 64
# Letters in every version of Unicode; other characters beyond ASCII may be letters or not.
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
#: Characters that may be letters or not, white space or not.
UNSURE = re.compile(f"[^\0-\x1b\x20-\x7f{LETTERS}]")
#: A word with a blank before it; single other white space; or white space with the letters, or the marks and digits,
#: after it, where letters stay with an apostrophe before them.
PARTS = re.compile(rf"\x20?[{LETTERS}]+|[\t-\r](?=\S)|\s*(?:[{LETTERS}]+|[^\s{LETTERS}]+(?:(?<=')[{LETTERS}]+)?)|\s+")
#: For texts with other characters: before a blank between two characters that are no white space.
BLANKS = re.compile(r"(?<=\S)(?= \S)")
WORD = re.compile(rf"\x20?[{LETTERS}]+")


def parts(text: str) -> list[str]:
    """``text`` cut at places where its tokens end in any case."""
    return BLANKS.split(text) if UNSURE.search(text) else PARTS.findall(text)


class Ids(dict):
    """The ids of parts as bytes; unknown parts are encoded."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode, self.before = encode, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part) or self.encode(part)
        if len(part) <= KEPT_LENGTH:
            if len(self) >= KEPT_PARTS:
                self.before = dict(self)
                self.clear()
            self[part] = ids
        return ids


def cuts_plainly(file: str) -> bool:
    """Whether the tokenizer at ``file`` gives ``parts`` one by one the ids that it gives the whole text."""
    with open(file, encoding="utf-8") as f:
        said = json.load(f)
    first = said.get("pre_tokenizer") or {}
    plain = first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and first.get("use_regex", True)
    # Added tokens are found before anything is cut, so that none may be cut itself.
    added = said.get("added_tokens", ())
    loose = any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or t.get("normalized") for t in added)
    return bool(plain) and not loose and not said.get("normalizer") and said["model"]["type"] == "BPE"


def joiner(added: list[str]) -> Callable[[str], list[str]]:
    """``parts``, with the added tokens as parts of their own."""
    if not added:
        return parts
    mark = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")")

    def cut(text: str) -> list[str]:
        if not any(a in text for a in added):
            return parts(text)
        return [p for i, s in enumerate(mark.split(text)) for p in ([s] if i % 2 else parts(s))]

    return cut


@functools.lru_cache(maxsize=2)
def encoder(file: str) -> Callable[[str], bytes]:
    """A function from a text to the bytes of its ids (little-endian, unsigned, 32 bits); made once in each worker."""
    import numpy as np
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(file)
    model = tok.model
    letters = [c for c in map(chr, range(0x250)) if WORD.fullmatch(c)]

    def pack(*ids: int) -> bytes:
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def whole(text: str) -> bytes:
        return np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(text: str) -> bytes:
        # One word needs no cutting any more, only its bytes as the model writes them.
        if WORD.fullmatch(text):
            return pack(*(t.id for t in model.tokenize(text.translate(written))))
        return whole(text)

    if not cuts_plainly(file):
        return whole
    written = str.maketrans({c: tok.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in (" ", *letters)})
    ids, cut = Ids(part), joiner([t.content for t in tok.get_added_tokens_decoder().values()])
    return lambda text: b"".join(map(ids.__getitem__, cut(text)))
