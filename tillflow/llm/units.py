"""Cutting a text where no byte-level BPE token can cross, and remembering the cuts' tokens.

A single space between two characters that are no white space always starts a
piece of the pattern: no alternative takes a space behind another character
except as a run of white space, and a run of one is left to the piece behind it.
Pieces are merged each on its own, so the parts can be encoded one by one.
"""

from __future__ import annotations

import re
import struct
import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# the longer way: only single spaces with no other white space beside them
STABLE = re.compile(r"(?<=\S) (?=\S)")
UNUSUAL = re.compile(r"[^\S \n]")
# a worker remembers so many parts (about 180 bytes each) before it starts anew
REMEMBERED = 1_000_000


# a word and the signs behind it; a letter ends a piece before any of these
SIGNS = ".,;:!?*#$%&)"
# of these, the ones that a batch of texts is cut at, where a space follows
ENDS = ".,;:!?"
# texts that a batch does not cut: white space other than single spaces and one or two line feeds between other characters
# (each of two is a piece of its own, of more only the last)
_OTHER = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace() and c not in " \n")
UNEVEN = rf"  | \n|\n |\n\n\n|\A\n|[ \n]\z|[{_OTHER}]"


def packed(encode: Callable[[str], list[int]], width: int) -> Callable[[str], bytes]:
    """``encode`` with its ids as little-endian numbers of 2 or 4 bytes."""
    kind = {2: "<%dH", 4: "<%dI"}[width]

    def run(text: str) -> bytes:
        ids = encode(text)
        return struct.pack(kind % len(ids), *ids)
    return run


class Parts(dict):
    """Tokens by part, encoded when first met.

    Parts other than a text's first stand without the space before them; keys
    that begin with a line feed stand for what has no space before it.
    ``words`` encodes many words of letters at once, each with a space before
    it; it returns nothing for those that it cannot. ``added`` are the strings
    that ``encode`` takes out of a text before it cuts pieces.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int = REMEMBERED,
                 words: Callable[[list[str]], dict[str, bytes]] | None = None, added: Sequence[str] = ()):
        super().__init__()
        self.encode, self.most, self.words = encode, most, words
        self.uneven = "|".join([UNEVEN, *map(re.escape, added)])
        self.line_feed = encode("\n")

    def all(self, some: list[str]) -> list[bytes]:
        """The tokens of each of many parts."""
        found, at = list(map(self.get, some)), -1
        missing = []
        for _ in range(found.count(None)):
            at = found.index(None, at + 1)
            missing.append(at)
        if self.words and missing:
            bare = {some[i].rstrip(SIGNS) for i in missing}
            made = self.words([w for w in bare if w.isalpha() and w not in self])
            if len(self) + len(made) >= self.most:
                self.clear()
            self.update(made)
        for i in missing:
            found[i] = self[some[i]]
        return found

    def __missing__(self, part: str) -> bytes:
        bare = part.rstrip(SIGNS)
        if bare and bare[-1].isalpha() and len(bare) < len(part):
            # signs behind a letter are a piece of their own
            value = self[bare] + self["\n" + part[len(bare):]]
        elif part[:1] == "\n":
            value = self.encode(part[1:])
        else:
            head, feed, rest = part.partition("\n")
            if feed and head and rest and not head[-1].isspace() and not rest[0].isspace():
                # one line feed between two words is a piece of its own
                value = self[head] + self.line_feed + self["\n" + rest]
            else:
                value = self.encode(" " + part)
        if len(self) >= self.most:
            self.clear()
        self[part] = value
        return value


def split(text: str) -> list[str]:
    """The parts of a text; each but the first has lost the space before it."""
    if ("  " in text or " \n" in text or "\n " in text or text[-1:] == " "
            # other white space is not printable, which is known sooner than a search
            or not text.replace("\n", "").isprintable() and UNUSUAL.search(text)):
        return STABLE.split(text)
    return text.split(" ")


def encode(text: str, parts: Parts) -> bytes:
    """The tokens of a whole text, as the parts' encoder serializes them."""
    first, *rest = split(text)
    head = parts.encode(first) if first else b""
    return head + b"".join(map(parts.__getitem__, rest))


def _cut(text: str) -> str:
    """A text whose parts are whatever stands between spaces, line feeds and signs behind a word among them."""
    text = "\n" + text.replace("\n", " \n\n \n")
    for sign in ENDS:
        if sign in text:
            text = text.replace(f"{sign} ", f" \n{sign} ")
    return text


def encode_batch(texts: list[str], parts: Parts) -> list[bytes]:
    """``encode`` of every text; a part is looked up once for all its places in them."""
    column = pa.array(texts, pa.large_string())
    alone = pc.match_substring_regex(column, parts.uneven).to_numpy(zero_copy_only=False)
    even = np.flatnonzero(~alone)
    cut = pc.split_pattern(pa.array([_cut(texts[i]) for i in even], pa.large_string()), " ")
    flat, offsets = cut.values.dictionary_encode(), cut.offsets.to_numpy()
    places = flat.indices.to_numpy()
    # parts hold no space
    one = pa.ListArray.from_arrays(pa.array([0, len(flat.dictionary)], pa.int32()), flat.dictionary)
    different = pc.binary_join(one, pa.scalar(" ", pa.large_string()))[0].as_py().split(" ") if len(places) else []

    # a sign is a piece of its own behind a letter or digit; where it is behind another sign the text is encoded alone
    signs = [i for i, p in enumerate(different) if len(p) == 2 and p[0] == "\n" and p[1] in ENDS]
    at = np.flatnonzero(np.isin(places[1:], signs))
    before = np.unique(places[at])
    wrong = [i for i in before.tolist() if not (different[i][-1:].isalpha() or different[i][-1:] in set("0123456789"))]
    alone[even[np.searchsorted(offsets, at[np.isin(places[at], wrong)] + 1, "right") - 1]] = True

    tokens = pa.array(parts.all(different), pa.large_binary()).take(flat.indices)
    _, ends, data = tokens.buffers()
    ends = np.frombuffer(ends, np.int64)[offsets].tolist() if len(places) else [0]
    data = data.to_pybytes() if data else b""
    done = dict(zip(even.tolist(), (data[a:b] for a, b in zip(ends, ends[1:]))))
    return [encode(t, parts) if alone[i] else done[i] for i, t in enumerate(texts)]
