r"""Token counts of whole texts, as the tokenizers library gives them, by rank-synchronous array merging (see bpe.py).

A text is cut at the special strings (one token each, found before normalisation, as the library does), brought to NFC
and lower case and split at white space. Each distinct word is split once into the pattern's pre-tokens, whose bytes
are merged in one ragged batch; the number of surviving symbols is the word's count. A worker keeps the counts of the
words it has met, up to a bound, so that a frequent word is merged about once.

Defined results: a null text counts as empty, with 0 tokens; texts are never cut short; repeated rows are counted each;
an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from .bpe import Merges
from .common import named, slices, small_batches, tidy

#: Words of one of a worker's two tables; the older one goes when the newer is full.
REMEMBERED = 200_000
#: What the library's \s is: Unicode White_Space. str.split() also cuts at the four separators \x1c to \x1f.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def byte_characters() -> dict[int, str]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for U+0100 onwards, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCounter:
    """Counts of a tokenizer file of this kind: BPE with a suffix on a word's last byte, over byte-level characters, with a Split pre-tokenizer that removes white space."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        split = next(x for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"].replace("\\s", SPACE) if "[^\\s" in split["pattern"]["Regex"] else split["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(x["content"]) for x in sorted(spec["added_tokens"], key=lambda x: -len(x["content"])))) if spec["added_tokens"] else None
        self.kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        suffix = model["end_of_word_suffix"] or ""
        chars = byte_characters()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[chars[b] + suffix] for b in range(256)], np.int64)
        pairs = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], np.int64)
        self.merges = Merges(ids[:, 0], ids[:, 1], np.arange(len(pairs)), ids[:, 2])
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.odd = regex.compile("[\\x1c-\\x1f]")
        self.spaces = regex.compile(f"[{SPACE}]+")

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each capital by itself: no final sigma
        return text.lower()

    def words(self, text: str) -> list[str]:
        return [x for x in self.spaces.split(text) if x] if self.odd.search(text) else text.split()

    def of_words(self, words: list[str]) -> np.ndarray:
        """Counts of distinct words."""
        known, old = self.known, self.old
        new = [x for x in words if x not in known and x not in old]
        found: dict[str, int] = {}
        if new:
            pieces: list[bytes] = []
            own = np.empty(len(new), np.int64)
            for i, w in enumerate(new):
                got = self.pattern.findall(w)
                own[i] = len(got)
                pieces += [x.encode() for x in got]
            lens = np.fromiter(map(len, pieces), np.int64, len(pieces))
            flat = np.frombuffer(b"".join(pieces), np.uint8)
            sym = self.inner[flat]
            ends = np.cumsum(lens) - 1
            sym[ends] = self.last[flat[ends]]
            left = self.merges.merge(sym, lens)[1]
            sums = np.concatenate([[0], np.cumsum(left)])
            after = np.cumsum(own)
            counts = sums[after] - sums[after - own]
            found = dict(zip(new, counts.tolist(), strict=True))
        out = [found[x] if x in found else known[x] if x in known else old[x] for x in words]
        if len(known) + len(words) > REMEMBERED:
            self.old, self.known = known, {}
        self.known.update(x for x in zip(words, out, strict=True) if len(x[0]) <= 64)
        return np.array(out, np.int64)

    def count(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), np.int64)
        flat: list[str] = []
        sizes = np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            parts = [t]
            if self.special is not None and "<|" in t:
                parts = self.special.split(t)
                extra[i] = len(parts) - 1
            n = len(flat)
            for p in parts:
                flat += self.words(self.normal(p))
            sizes[i] = len(flat) - n
        if not flat:
            return extra
        coded = pa.array(flat, pa.string()).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        per = self.of_words(distinct)[codes]
        sums = np.concatenate([[0], np.cumsum(per)])
        after = np.cumsum(sizes)
        return extra + sums[after] - sums[after - sizes]


_COUNTERS: dict[str, WordCounter] = {}


def counter(path: str) -> WordCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = WordCounter(path)
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, n_bytes (UTF-8), n_tokens, over_limit. tokenizer: the file's path on every worker."""
    small_batches(docs.sparkSession)
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            for i, j in slices(text):
                part = text.slice(i, j - i)
                n = counter(tokenizer).count(part.to_pylist())
                size = pc.cast(pc.binary_length(part), pa.int64())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
