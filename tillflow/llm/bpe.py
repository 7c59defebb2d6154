"""Byte-level BPE by a table of prefixes.

Two tokens may stand next to each other only if merging their bytes afresh
gives just these two, and a row of tokens is the encoding if each neighbouring
pair may. So each prefix of a piece has exactly one valid last token: found
from shorter prefixes, it gives the encoding of an appended text without
looking back, and after an edit only the prefixes behind it change.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

import public_tokenizers
from tillflow.llm import units
from tillflow.llm.frames import kept, map_texts, table, texts
from tillflow.llm.registry import query

RANKS = "byte_bpe_50k.tiktoken"
NEVER = 1 << 60
# pieces up to this length share one table of prefixes, longer ones have their own
SHARED_BYTES = 64
# what a worker remembers before it starts anew, some 250 MB in all; less of it costs more time than memory
SHARED_PREFIXES, PAIRS, PARTS = 600_000, 300_000, 500_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _merge(data: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merging with the ranks under ``below``, lowest rank first, leftmost of equals."""
    parts = [data[i:i + 1] for i in range(len(data))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at:at + 2] = [parts[at] + parts[at + 1]]
    return parts


class PrefixBpe:
    """Encoder and decoder for one table of ranks (id = rank) and one pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids, self.pattern = ranks, regex.compile(pattern)
        self.bytes = [b""] * (max(ranks.values()) + 1)
        self.left, self.right, self.born = {}, {}, {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            self.bytes[rank] = token
            if len(token) > 1:
                parts = _merge(token, ranks, rank)
                if len(parts) != 2:
                    continue  # no merge makes it: it stands only for a whole piece
                a, b = ranks[parts[0]], ranks[parts[1]]
                self.left[rank], self.right[rank], self.born[a, b] = a, b, rank
        self.reachable = {r for t, r in ranks.items() if len(t) == 1} | set(self.left)
        self.endings = {t[i:] for t in ranks for i in range(len(t))}
        self.prefixes: dict[bytes, int] = {}
        self.pairs: dict[int, bool] = {}

    def _edge(self, token: int, inner: dict[int, int]) -> list[tuple[int, int]]:
        """A token's parts at one edge, each with the rank of the merge that ended it."""
        chain = [(token, NEVER)]
        while chain[-1][0] in inner:
            chain.append((inner[chain[-1][0]], chain[-1][0]))
        return chain

    def may_follow(self, a: int, b: int) -> bool:
        """No merge across the border of a and b comes before the merges that use up its two sides."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = True
            for x, x_ends in self._edge(a, self.right):
                for y, y_ends in self._edge(b, self.left):
                    rank = self.born.get((x, y))
                    # of equal ranks the leftmost merge is done first
                    if rank is not None and rank < x_ends and rank <= y_ends:
                        known = False
                        break
                if not known:
                    break
            self.pairs[a << 32 | b] = known
        return known

    def _last(self, piece: bytes, end: int, last_of) -> int:
        """The one token that may end the prefix, ``last_of`` giving those of shorter prefixes."""
        start = end - 1
        while start >= 0 and piece[start:end] in self.endings:
            token = self.ids.get(piece[start:end])
            if token is not None and token in self.reachable and (
                    start == 0 or self.may_follow(last_of(start), token)):
                return token
            start -= 1
        raise ValueError("the ranks lack a byte")

    def last_tokens(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """The last token of each prefix; ``known`` are those of a prefix that stays as it was."""
        lasts = list(known or [])
        for end in range(len(lasts) + 1, len(piece) + 1):
            lasts.append(self._last(piece, end, lambda n: lasts[n - 1]))
        return lasts

    def encode_piece(self, piece: bytes) -> list[int]:
        if piece in self.ids:
            return [self.ids[piece]]
        out, at = [], len(piece)
        if at > SHARED_BYTES:
            lasts = self.last_tokens(piece)
            while at:
                out.append(lasts[at - 1])
                at -= len(self.bytes[out[-1]])
            return out[::-1]
        prefixes = self.prefixes
        if len(prefixes) >= SHARED_PREFIXES:
            prefixes.clear()
        known = at
        while known and piece[:known] not in prefixes:
            known -= 1
        for end in range(known + 1, at + 1):
            # shorter prefixes are stored together with a longer one, so they are known
            prefixes[piece[:end]] = self._last(piece, end, lambda n: prefixes[piece[:n]])
        while at:
            out.append(prefixes[piece[:at]])
            at -= len(self.bytes[out[-1]])
        return out[::-1]

    def encode(self, text: str) -> list[int]:
        out = []
        for piece in self.pattern.findall(text):
            out += self.encode_piece(piece.encode())
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def codec(ranks_path: str) -> tuple[PrefixBpe, units.Parts]:
    """The worker's encoder and its memory of parts."""
    def make():
        bpe = PrefixBpe(load_ranks(ranks_path), public_tokenizers.PATTERN)
        return bpe, units.Parts(units.packed(bpe.encode, 4), PARTS)
    return kept(f"bpe {ranks_path}", make)


def encode_texts(batch: list[str], ranks_path: str, with_ids: bool) -> dict[str, list]:
    bpe, parts = codec(ranks_path)
    made = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": []} if with_ids else {})
    names = kept(f"decimal {ranks_path}", lambda: [str(i).encode() for i in range(len(bpe.bytes))])
    for text in batch:
        data = np.frombuffer(units.encode(text, parts), "<u4")
        ids = data.tolist()
        made["n_tokens"].append(len(ids))
        made["ids_sha256"].append(hashlib.sha256(b" ".join(map(names.__getitem__, ids))).hexdigest())
        made["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        if with_ids:
            made["ids"].append(data.astype(np.int32))
    if with_ids:
        # one flat buffer, no number of Python's own for each id of the batch
        ends = np.concatenate(([0], np.cumsum(made["n_tokens"]))).astype(np.int32)
        made["ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made["ids"] or [np.zeros(0, np.int32)])))
    return made


def encode_documents(docs: DataFrame, id_col: str = "doc_id", ranks_path: str | None = None,
                     with_ids: bool = True) -> DataFrame:
    """``(id, n_tokens, ids_sha256, decoded_sha256[, ids])`` for every row.

    The whole text is encoded by the ranks, each match of the pattern on its
    own, and decoded again. Null texts count as empty: no tokens, digests of
    nothing. Repeated rows and repeated or null ids give one row each, an empty
    table none. Extra columns of ``docs`` are left out.
    """
    path = ranks_path or public_tokenizers.path(RANKS)
    schema = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return map_texts(texts(docs, id_col), lambda batch: encode_texts(batch, path, with_ids), schema)


@query("op7_bpe")
def op7_bpe(spark, folder):
    """Every document's token count and the digests of its ids and of their decoding."""
    return encode_documents(table(spark, folder, "documents"), with_ids=False)
