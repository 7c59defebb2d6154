"""Token counts; huge documents in overlapping chunks that are joined where both agree."""

from __future__ import annotations

import codecs
import os
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

import public_tokenizers
from tillflow.llm import units
from tillflow.llm.frames import kept, map_texts, table
from tillflow.llm.registry import query

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512
# characters: longer texts are cut into chunks that share an overlap
HUGE, CHUNK, OVERLAP = 1 << 16, 1 << 14, 256
# words in one call of the model
TOGETHER = 100
# letters up to here are letters in every version of Unicode
BEYOND_LATIN = re.compile("[^\0-\u024f]")


def tokenizer(path: str):
    """The worker's tokenizer; its library keeps to one thread, Spark has the others."""
    def make():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        found = Tokenizer.from_file(path)
        found.no_truncation()
        found.no_padding()
        return found
    return kept(f"tokenizer {path}", make)


def added_tokens(tok) -> list[str]:
    return [t.content for t in tok.get_added_tokens_decoder().values()]


def _plain(tok) -> bool:
    """Whether the model alone encodes a word of letters."""
    return (type(tok.pre_tokenizer).__name__ == "ByteLevel" and tok.normalizer is None
            and not any(t.isalpha() for t in added_tokens(tok)))


def part_ids(tok) -> Callable[[str], list[int]]:
    """The library's ids of one part; words of ASCII letters go straight to its model.

    With or without the space ahead such a word is one piece, which a
    byte-level pre-tokenizer would only hand on with the space as ``\u0120``.
    """
    plain = _plain(tok)
    tokenize, encode = tok.model.tokenize, tok.encode

    def ids(part: str) -> list[int]:
        spaced = part[:1] == " "
        word = part[1:] if spaced else part
        if plain and word.isascii() and word.isalpha():
            return [t.id for t in tokenize("\u0120" + word if spaced else word)]
        return encode(part, add_special_tokens=False).ids
    return ids


def _byte_characters() -> str:
    """The characters that stand for the bytes 0 to 255 in a byte-level vocabulary."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(others)) for b in range(256))


def words_ids(tok, width: int) -> Callable[[list[str]], dict[str, bytes]] | None:
    """The library's ids of many words of Latin letters, each with a space before it, from few calls of its model.

    The model gets words side by side. No merge joins a letter and a space
    behind it, which is looked up in the vocabulary; so every word has the
    tokens it has alone, and a token that begins with a space begins a word.
    """
    model, characters = tok.model, _byte_characters()
    vocabulary, space = tok.get_vocab(), characters[32]
    joined = {bytes(map(characters.index, t)).decode(errors="replace") for t in vocabulary
              if space in t[1:] and set(t) <= set(characters)}
    if (not _plain(tok) or model.dropout or model.ignore_merges or model.continuing_subword_prefix or model.end_of_word_suffix
            or any(before.isalpha() or before == "\ufffd" for t in joined for before, sign in zip(t, t[1:]) if sign == " ")):
        return None
    first = np.zeros(max(vocabulary.values()) + 1, bool)
    first[[i for t, i in vocabulary.items() if t[0] == space]] = True

    def run(words: list[str]) -> dict[str, bytes]:
        out = {}
        words = [w for w in words if not BEYOND_LATIN.search(w)]
        for at in range(0, len(words), TOGETHER):
            some = words[at:at + TOGETHER]
            text = codecs.charmap_decode((" " + " ".join(some)).encode(), "strict", characters)[0]
            ids = np.array([t.id for t in model.tokenize(text)], f"<u{width}")
            data, begins = ids.tobytes(), (np.flatnonzero(first[ids]) * width).tolist()
            out.update(zip(some, (data[a:b] for a, b in zip(begins, [*begins[1:], len(data)]))))
        return out
    return run


def _starts(tok, text: str, at: int) -> np.ndarray:
    """Where in the whole text each token of the chunk ``text`` begins."""
    return np.array([a for a, _ in tok.encode(text, add_special_tokens=False).offsets], np.int64) + at


def spliced_count(tok, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The number of tokens of a text that is encoded in overlapping chunks.

    Two neighbouring chunks are joined at the first place in their overlap that
    is a token's start in both and that no token can cross whatever stands
    before or behind it (``units.STABLE``). If they have none in common the
    overlap is widened and both are encoded again, up to the whole text.
    """
    total, begin, counted = 0, 0, 0  # tokens before ``counted`` are in ``total``
    while True:
        length, wide = chunk, overlap
        while True:
            end = min(len(text), begin + length + wide)
            here = _starts(tok, text[begin:end], begin)
            if end == len(text):
                return total + int((here >= counted).sum())
            nxt = end - wide  # the next chunk's start
            there = _starts(tok, text[nxt:min(len(text), nxt + wide + overlap)], nxt)
            stable = {m.start() for m in units.STABLE.finditer(text, nxt, end)}
            common = stable.intersection(here.tolist(), there.tolist())
            if common:
                break
            length, wide = 2 * length, 2 * wide
        joint = min(common)
        total += int(((here >= counted) & (here < joint)).sum())
        begin, counted = nxt, joint


def count_tokens(tok, parts: units.Parts, text: str) -> int:
    if len(text) > HUGE:
        return spliced_count(tok, text)
    return len(units.encode(text, parts)) // 4


def _parts(path: str) -> units.Parts:
    tok = tokenizer(path)
    return kept(f"parts {path}", lambda: units.Parts(units.packed(part_ids(tok), 4)))


def token_counts(docs: DataFrame, id_col: str = "doc_id", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """``(id, n_bytes, n_tokens, over_limit)`` for every row's whole text.

    Tokens are those of the byte-level tokenizer file at ``path``, strings of
    special tokens inside a text included as the library does by default. Null
    texts count as empty: 0 bytes, 0 tokens. Repeated rows and repeated or null
    ids give one row each, an empty table none. Extra columns are left out.
    """
    path = path or public_tokenizers.path(VOCABULARY)

    def count(batch: list[str]) -> dict[str, list]:
        tok, parts = tokenizer(path), _parts(path)
        return {"n_tokens": [count_tokens(tok, parts, t) for t in batch]}

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(id_col, F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    return map_texts(sized, count, "n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


@query("op6_token_counts")
def op6_token_counts(spark, folder):
    """Every document's bytes and tokens."""
    return token_counts(table(spark, folder, "documents"))
