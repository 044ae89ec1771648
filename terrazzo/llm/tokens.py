"""Token counts under public tokenizers, with huge documents encoded in overlapping chunks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

VOCABULARY = "byte_bpe_50k.json"
#: Characters of a chunk, and of the first overlap tried; texts up to one chunk are encoded whole.
CHUNK, OVERLAP = 1 << 15, 1 << 8
LIMIT = 1024
#: Most characters of the words whose token count a worker remembers.
REMEMBERED = 8_000_000

#: Fixed value: how byte-level BPE files split texts into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same in the quicker standard library, for texts of characters on which both agree.
QUICK = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
UNSURE = re.compile(r"[^\t-\r\x20-\x7eÀ-ɏ]")
FULL = regex.compile(SPLIT)


def _drops_blanks(splitter: dict) -> bool:
    """Whether a splitter's own pattern removes blanks, so that none is in any word."""
    steps = splitter.get("pretokenizers") or [splitter]
    return any(x.get("type") == "Split" and x.get("behavior") == "Removed" and x.get("invert") and " " not in "".join((x.get("pattern") or {}).values()) for x in steps)


class TokenCounter:
    """Counts tokens as the vocabulary file's library does, without begin, end or other added tokens."""

    def __init__(self, path: str, chunk: int = CHUNK, overlap: int = OVERLAP):
        self.chunk, self.overlap = chunk, overlap
        self.known: dict[str, int] = {}
        self.held = 0
        self.model = self.specials = self.blanks = None
        if path.endswith(".model"):
            import sentencepiece

            self.model = sentencepiece.SentencePieceProcessor(model_file=path)
            mark = "\u2581"
            pieces = map(self.model.id_to_piece, range(self.model.get_piece_size()))
            self.blanks = None if any(mark in p.lstrip(mark) for p in pieces) else "first"
            self.by_words = False
            return
        import json

        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        before = spec.get("pre_tokenizer") or {}
        plain = not spec.get("normalizer") and not spec.get("truncation") and not spec["model"].get("dropout")
        added = spec.get("added_tokens") or []
        # Words stand for themselves only under this splitter; any other file is encoded text by text.
        self.by_words = (
            plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
            and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
        )
        self.blanks = "first" if self.by_words else "dropped" if _drops_blanks(before) else None
        if added and self.blanks:
            # Longest first; the library also takes the leftmost and then the longest.
            self.specials = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))))

    def _learn(self, words: set[str]) -> None:
        """Ask the library for words that are not known yet."""
        new = list(words.difference(self.known))
        self.held += sum(map(len, new))
        if self.held > REMEMBERED:
            self.known.clear()
            new, self.held = list(words), sum(map(len, words))
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            self.known.update(zip(part, map(len, self.library.encode_batch_fast(part, add_special_tokens=False)), strict=True))

    @staticmethod
    def _splitter(text: str):
        return FULL if UNSURE.search(text) else QUICK

    def _stable(self, text: str, at: int, words: set[int] | None) -> bool:
        """Whether tokens on both sides of a token boundary are proven to be those of the whole text.

        No token of these vocabularies holds a blank after another character: byte-level splitters put a blank first,
        lower-casing ones drop blanks, and for pieces this is looked up once. So what begins at such a blank, or
        after a dropped one, is encoded as if the text began there. Besides, byte-level splitters go from left to right
        and look ahead one character at most, so that a word boundary that splits from two beginnings share is one
        of the whole text.
        """
        before, here = text[at - 1], text[at]
        if self.blanks == "first" and here == " " and not before.isspace():
            return True
        if self.blanks == "dropped" and before == " " and not here.isspace():
            return True
        return words is not None and at in words

    def _encode(self, text: str, at: int, end: int) -> tuple[list[int], set[int] | None]:
        """Where each token of a chunk begins, as places in the text, and where its words do, if words stand alone."""
        part = text[at:end]
        if self.model is not None:
            pieces = self.model.encode(part, return_type="proto", num_threads=1).pieces
            # The library counts bytes; a place inside a character is that of the character.
            lead = np.cumsum((np.frombuffer(part.encode() + b" ", np.uint8) & 0xC0) != 0x80) - 1
            return [at + int(lead[p.begin]) for p in pieces], None
        got = self.library.encode(part, add_special_tokens=False)
        starts = [at + a for a, _ in got.offsets]
        if not self.by_words:
            return starts, None
        ids = got.word_ids
        return starts, {s for k, s in enumerate(starts) if k == 0 or ids[k] != ids[k - 1]}

    def _count_long(self, text: str) -> int:
        """Tokens of a huge text, encoded in overlapping chunks with offsets.

        A chunk and the next, which begins within it, are spliced at the first boundary in their overlap that both have and
        that is stable: tokens before it are the former's, tokens from it on the latter's. If there is none, the
        overlap is doubled, if need be to the whole of the former chunk, and the next chunk grows with it, so that a
        text without any stable boundary is at last encoded in one piece.
        """
        n, total, origin, start, end = len(text), 0, 0, 0, min(len(text), self.chunk)
        starts, words = self._encode(text, origin, end)
        while end < n:
            overlap = self.overlap
            while True:
                at = max(start, end - overlap)
                far = min(n, max(end, at) + max(self.chunk, overlap))
                cut = start
                if at > start:
                    more, others = self._encode(text, at, far)
                    ours, shared = set(starts), None if words is None else words & others
                    # A chunk's last character may yet change its word.
                    cut = next((b for b in more if at < b < end - 1 and b in ours and self._stable(text, b, shared)), None)
                if cut is not None:
                    break
                overlap *= 2
            if at > start:
                total += sum(b < cut for b in starts)
                origin, start = at, cut
            else:  # the chunk itself grows, from where it was begun
                more, others = self._encode(text, origin, far)
            starts, words = [b for b in more if b >= start], None if others is None else {b for b in others if b >= start}
            end = far
        return total + len(starts)

    def count(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            parts, extra = [text], 0
            if self.specials and self.specials.search(text):
                parts = self.specials.split(text)
                extra = len(parts) - 1
            for part in parts:
                if len(part) > self.chunk:
                    extra += self._count_long(part)
                elif self.model is not None:
                    extra += len(self.model.encode(part, num_threads=1))
                elif not self.by_words:
                    extra += len(self.library.encode(part, add_special_tokens=False))
                elif part:
                    words = self._splitter(part).findall(part)
                    try:
                        extra += sum(map(self.known.__getitem__, words))
                    except KeyError:
                        self._learn(set(words))
                        extra += sum(map(self.known.__getitem__, words))
            out.append(extra)
        return out


_counters: dict[str, TokenCounter] = {}


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each row, over its whole text.

    ``vocabulary`` names a file of the tokenizer package that every executor has. A null text counts as empty, with 0
    bytes and tokens. Special strings inside texts count as the library counts them by default. Rows are neither
    merged nor dropped; other columns are not read.
    """

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        if vocabulary not in _counters:
            _counters[vocabulary] = TokenCounter(public_tokenizers.path(vocabulary))
        return pa.array(_counters[vocabulary].count([t or "" for t in texts.to_pylist()]), pa.int64())

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = docs.select("doc_id", n_bytes.alias("n_bytes"), of(F.col("text")).alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
