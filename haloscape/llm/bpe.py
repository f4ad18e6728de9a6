"""BPE encoding and decoding by backtracking over Aho-Corasick matches.

A piece of text is encoded left to right with the longest token that starts at the current place (from an Aho-Corasick
automaton over all tokens).  A token may follow the last one only if merging the two tokens' texts by the merge list leaves
exactly these two: the pair-compatibility test, whose answers are kept in a table.  If no token fits, the last one is taken
back and a place that proved a dead end is never tried again; so each place is left at most once and the time is linear.  The
result is that of applying the merges in order.  Decoding looks each id up in a table of offsets into one string of all tokens.

The tokenizer file (JSON of the ``tokenizers`` library) is a parameter; the driver reads it and broadcasts its bytes, up to ``MAX_FILE`` of them; a
larger file is fetched by each executor once, as a file of the application.  Supported
files: BPE with an end-of-word suffix, normalised by NFC, white space to one space, and lower case; pieces by the
file's split pattern, then mapped byte by byte.  Without a decoder in the file, decoded tokens are joined by a space.  Special
tokens in a text become their own ids, as in the library.

Defined results: a null text is encoded as an empty one (no tokens, empty decoded text); every row gives a row, repeated rows repeated; columns named
like an added one are replaced, unless it is the text's own, which is an error; all others stay; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import frugal, others

MAX_FILE = 64 << 20
#: Encoded words that a task remembers: the first so many that it sees, which common words are among.
MAX_WORDS = 500_000
ADDED = ("token_ids", "decoded")
#: Unicode's White_Space, which is what the file's \s means.
WHITE = "\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The letter of each byte: printable Latin-1 stands for itself, the others follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Bpe:
    """One tokenizer file."""

    def __init__(self, data: bytes):
        import ahocorasick
        import regex

        spec = json.loads(data)
        model = spec["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"]
        if not self.suffix or spec["decoder"] is not None or model["unk_token"] or model["byte_fallback"]:
            raise ValueError("this kind of tokenizer file isn't supported")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(pattern.replace("\\s", WHITE) if "[^\\s" in pattern else pattern)
        # str.split() takes these for white space as well, the file doesn't
        self.odd = regex.compile("[\x1c-\x1f]")
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")") if self.specials else None
        self.letters = byte_letters()
        # inner numbers: letters first, then the merges in order; merging order is then number order
        made = {a + b for a, b in merges}
        base = [t for t in vocab if t not in made]
        inner = {t: i for i, t in enumerate(base)}
        self.split = [(i, i) for i in range(len(base))]
        self.pairs = {}
        for a, b in merges:
            if a + b in inner:
                raise ValueError("two merges make one token")
            inner[a + b] = len(self.split)
            self.pairs[inner[a], inner[b]] = len(self.split)
            self.split.append((inner[a], inner[b]))
        self.ids = [vocab[t] for t in inner]
        # the suffix counts as one character, so that a token's length is its number of characters
        shown = [t[: -len(self.suffix)] + "\0" if t.endswith(self.suffix) and len(t) > len(self.suffix) else t for t in inner]
        self.width = [len(t) for t in shown]
        self.matches = ahocorasick.Automaton()
        for n, t in enumerate(shown):
            self.matches.add_word(t, n)
        self.matches.make_automaton()
        number = {t: n for n, t in enumerate(shown)}
        #: the longest shorter token that a token starts with
        self.shorter = [next((number[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in number), -1) for t in shown]
        self.compatible: dict[tuple[int, int], bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        # decoding: one string and the offsets of each id
        by_id = {i: t for t, i in vocab.items()} | {i: t for t, i in self.specials.items()}
        texts = [by_id.get(i, "") for i in range(max(by_id) + 1)]
        self.text, self.offsets = "".join(texts), [0]
        for t in texts:
            self.offsets.append(self.offsets[-1] + len(t))

    def fits(self, a: int, b: int) -> bool:
        """Merging the texts of ``a`` and ``b`` leaves these two tokens: undoing their merges, latest first, no pair that meets at
        the border would have been merged earlier."""
        known = self.compatible.get((a, b))
        if known is None:
            if len(self.compatible) > 2 * MAX_WORDS:
                self.compatible.clear()
            known = self.compatible[a, b] = self._fits(a, b)
        return known

    def _fits(self, a: int, b: int) -> bool:
        limit = len(self.split)
        while True:
            if self.pairs.get((a, b), limit) < limit:
                return False
            right, left = self.split[a][1], self.split[b][0]
            if right == a and left == b:
                return True
            if left == b or (a > b and right != a):
                limit, a = a, right
            else:
                limit, b = b + 1, left

    def encode_letters(self, word: str) -> list[int]:
        """Inner numbers of a word that ends with the suffix's mark.  The longest matches in a row are the answer if each fits the
        one before it; else the search goes back as far as it must."""
        straight = [n for _, n in self.matches.iter_long(word)]
        if sum([self.width[n] for n in straight]) == len(word) and all([self.fits(a, b) for a, b in zip(straight, straight[1:], strict=False)]):
            return straight
        return self.encode_back(word)

    def encode_back(self, word: str) -> list[int]:
        longest = [-1] * len(word)
        for end, n in self.matches.iter(word):
            start = end + 1 - self.width[n]
            if longest[start] < 0 or self.width[n] > self.width[longest[start]]:
                longest[start] = n
        open_at = bytearray(b"\1") * (len(word) + 1)
        out: list[int] = []
        at, n = 0, longest[0]
        while at < len(word):
            while n >= 0 and not (open_at[at + self.width[n]] and (not out or self.fits(out[-1], n))):
                n = self.shorter[n]
            if n >= 0:
                out.append(n)
                at += self.width[n]
                n = longest[at] if at < len(word) else -1
            else:
                if not out:
                    raise ValueError("a letter is missing from the vocabulary")
                open_at[at] = 0
                n = out.pop()
                at -= self.width[n]
        return out

    def encode_word(self, word: str) -> tuple[int, ...]:
        """Ids of a run without white space, whose pieces the split pattern gives."""
        letters, out = self.letters, []
        for piece in self.piece.findall(word):
            out += self.encode_letters("".join([letters[b] for b in piece.encode()]) + "\0")
        found = tuple([self.ids[n] for n in out])
        if len(self.words) < MAX_WORDS and len(word) < 100:
            self.words[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        parts = self.special.split(text) if self.special else [text]
        known, encode_word = self.words.get, self.encode_word
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.specials[part])
                continue
            if not part.isascii():  # letter by letter: no rule for a sigma at a word's end
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ")
            part = part.lower()
            if self.odd.search(part):
                out += encode_word(part)
                continue
            for word in part.split():
                ids = known(word)
                out += encode_word(word) if ids is None else ids
        return out

    def decode(self, ids: list[int]) -> str:
        text, offsets = self.text, self.offsets
        return " ".join([text[offsets[i] : offsets[i + 1]] for i in ids])


@lru_cache(maxsize=1)
def loaded(data: bytes) -> Bpe:
    """A worker keeps its tokenizer from one task to the next."""
    return Bpe(data)


def tokenizer_bytes(spark: SparkSession, tokenizer_file: str) -> Callable[[], bytes]:
    """What gives the file's bytes on an executor."""
    if os.path.getsize(tokenizer_file) > MAX_FILE:
        spark.sparkContext.addFile(tokenizer_file)
        name = os.path.basename(tokenizer_file)

        def fetched() -> bytes:
            from pyspark import SparkFiles

            with open(SparkFiles.get(name), "rb") as f:
                return f.read()

        return fetched
    with open(tokenizer_file, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())
    return lambda: sent.value


def tokenize(documents: DataFrame, tokenizer_file: str, text_col: str = "text") -> DataFrame:
    """``documents`` with ``token_ids`` (array of int) and ``decoded`` (text of these ids)."""
    held = tokenizer_bytes(documents.sparkSession, tokenizer_file)
    plain = documents.select(*others(documents, ADDED))
    if text_col.lower() in ADDED:
        raise ValueError(f"the text's column can't be called {text_col}")
    at = plain.columns.index(text_col)
    names = plain.columns
    plain = plain.toDF(*[f"c{i}" for i in range(len(names))])  # Arrow stages take no names with dots
    schema = T.StructType([*plain.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        bpe = loaded(held())
        try:
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    flat, ends, decoded = [], [0], []
                    for value in part.column(at):
                        ids = bpe.encode(value.as_py() or "")
                        flat += ids
                        ends.append(len(flat))
                        decoded.append(bpe.decode(ids))
                    ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.array(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([*part.columns, ids, pa.array(decoded, pa.string())], names=[*part.schema.names, "token_ids", "decoded"])
        finally:  # an idle worker holds the tokenizer only, beside other operators' stages
            bpe.words.clear()
            bpe.compatible.clear()

    return plain.mapInArrow(frugal(run), schema).toDF(*names, *ADDED)
