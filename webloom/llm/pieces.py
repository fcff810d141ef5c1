r"""SentencePiece encoding and decoding by a distinct-chunk table.

For BPE models whose pieces never hold a white space marker after another character, a text's segmentation is that of
its marked words side by side. Each batch of documents becomes a table of its distinct marked words; every one is segmented once
(ragged merging, see bpe.py; a worker remembers words up to a bound) and decoded once, and ids and texts are
joined back to the documents by position. Byte pieces spell characters the model lacks, and turn back into them.

Defined results: a null text counts as empty and gives no ids; texts are never cut short; repeated rows are encoded
each; an empty table gives no rows. Models other than identity-normalised BPE of that kind are refused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .bpe import Merges
from .common import SLICE_BYTES, named, slices, small_batches, tidy

MARK = "▁"
#: Words of one of a worker's two tables; the older one goes when the newer is full.
REMEMBERED = 120_000


class Codec:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        if sp.normalize("Å Ａ\t a ") != f"{MARK}Å{MARK}Ａ\t{MARK}a{MARK}":
            raise ValueError("only models with identity normalisation and a leading marker are handled")
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece crosses a white space marker")
        self.bytes = np.zeros(256, np.int64)
        self.byte_of: dict[int, int] = {}
        for i in range(n):
            if sp.is_byte(i):
                self.byte_of[i] = b = int(self.pieces[i][3:5], 16)
                self.bytes[b] = i
        if len(self.byte_of) != 256:
            raise ValueError("only models with byte fallback are handled")
        self.unused = {i for i in range(n) if sp.is_control(i)}
        self.surface = [None if i in self.byte_of else " ⁇ " if i == sp.unk_id() else "" if i in self.unused else p.replace(MARK, " ") for i, p in enumerate(self.pieces)]
        self.decimal = [str(i) for i in range(n)]
        self.id_of = {self.pieces[i]: i for i in normal}
        # Symbols: ids, then characters that are no piece but stand in one, then, in encode(), other characters.
        self.symbol = dict(self.id_of)
        for p in list(self.id_of):
            for c in p:
                self.symbol.setdefault(c, n + len(self.symbol) - len(self.id_of))
        self.n_ids, self.n_symbols = n, n + len(self.symbol) - len(self.id_of)
        left, right, made = [], [], []
        for p, i in self.id_of.items():
            for k in range(1, len(p)):
                if p[:k] in self.symbol and p[k:] in self.symbol:
                    left.append(self.symbol[p[:k]])
                    right.append(self.symbol[p[k:]])
                    made.append(i)
        score = np.array([sp.get_score(i) for i in range(n)])
        made_ids = np.array(made, np.int64)
        place = {s: k for k, s in enumerate(sorted(set(score[made_ids].tolist()), reverse=True))}
        rank = np.array([place[score[i]] for i in made], np.int64)
        self.merges = Merges(np.array(left, np.int64), np.array(right, np.int64), rank, made_ids)
        self.chunk = re.compile(f"{MARK}+[^{MARK}]*")
        self.known: dict[str, tuple[int, bytes, str]] = {}
        self.old: dict[str, tuple[int, bytes, str]] = {}
        self.spelt = np.full(self.n_symbols, -1, np.int64)
        self.spelt[: self.n_ids] = np.arange(self.n_ids)

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(MARK + text.replace(" ", MARK)) if text else []

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk."""
        other: dict[str, int] = {}
        names: list[str] = []
        flat = "".join(chunks)
        sym = np.empty(len(flat), np.int64)
        points = np.frombuffer(flat.encode("utf-32-le"), np.uint32)
        kinds, at = np.unique(points, return_inverse=True)
        own = np.empty(len(kinds), np.int64)
        for k, p in enumerate(kinds.tolist()):
            c = chr(p)
            if c not in self.symbol:
                other[c] = self.n_symbols + len(names)
                names.append(c)
            own[k] = self.symbol.get(c, other.get(c, 0))
        sym = own[at]
        done, lens = self.merges.merge(sym, np.fromiter(map(len, chunks), np.int64, len(chunks)))
        odd = done >= self.n_ids
        if odd.any():  # characters without a piece become their bytes
            back = {v: k for k, v in self.symbol.items() if v >= self.n_ids}
            spell = {s: [int(self.bytes[b]) for b in (back[s] if s < self.n_symbols else names[s - self.n_symbols]).encode()] for s in np.unique(done[odd]).tolist()}
            seq = np.repeat(np.arange(len(lens)), lens)
            width = np.ones(len(done), np.int64)
            width[odd] = [len(spell[s]) for s in done[odd].tolist()]
            wide = np.repeat(done, width)
            wide[np.repeat(odd, width)] = [b for s in done[odd].tolist() for b in spell[s]]
            done, lens = wide, np.bincount(seq, weights=width, minlength=len(lens)).astype(np.int64)
        flat_ids, after = done.tolist(), np.cumsum(lens).tolist()
        return [flat_ids[a:b] for a, b in zip([0, *after], after, strict=False)]

    def decode_chunk(self, ids: list[int]) -> str:
        """The surface of ids; the leading marker of a whole text is the caller's to drop."""
        try:
            return "".join([self.surface[i] for i in ids])
        except TypeError:  # bytes among them
            pass
        out: list[str] = []
        run = bytearray()

        def flush() -> None:
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()

        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            flush()
            out.append(self.surface[i])
        flush()
        return "".join(out)

    def table(self, chunks: list[str]) -> list[tuple[int, bytes, str]]:
        """For each distinct chunk: how many ids, the ids as decimal text, the decoded text."""
        out: list = list(map(self.known.get, chunks))
        fresh: dict[str, tuple[int, bytes, str]] = {}
        miss = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in miss:
            if x := self.old.get(chunks[i]):
                out[i] = fresh[chunks[i]] = x
            else:
                new.append(i)
        if new:
            decimal = self.decimal
            for i, ids in zip(new, self.segment([chunks[i] for i in new]), strict=True):
                out[i] = x = (len(ids), ",".join([decimal[k] for k in ids]).encode(), self.decode_chunk(ids))
                if len(chunks[i]) <= 64:
                    fresh[chunks[i]] = x
        if len(self.known) + len(fresh) > REMEMBERED:
            self.old, self.known = self.known, fresh
        else:
            self.known.update(fresh)
        return out

    def encode_batch(self, texts: list[str]) -> tuple[list[np.ndarray], list[tuple[int, bytes, str]], list[np.ndarray]]:
        """The distinct-chunk table and, for each text, the rows of it that the text is made of."""
        flat: list[str] = []
        sizes: list[int] = []
        for t in texts:
            own = self.chunks(t)
            flat += own
            sizes.append(len(own))
        if not flat:
            return [], [np.zeros(0, np.int64) for _ in texts]
        coded = pa.array(flat, pa.string()).dictionary_encode()
        codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        return self.table(distinct), np.split(codes, np.cumsum(sizes)[:-1])


def _utf8(raw: bytes) -> str:
    """raw as UTF-8; each byte that starts no character becomes U+FFFD by itself."""
    try:
        return raw.decode()
    except UnicodeDecodeError:
        out, i = [], 0
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def decode(ids: list[int], model: str) -> str:
    """The text of ids, as the library decodes them: the first piece loses one leading marker."""
    c = codec(model)
    text = c.decode_chunk(ids)
    first = next((i for i in ids if i not in c.unused), None)
    return text[1:] if first is not None and c.pieces[first].startswith(MARK) else text


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: doc_id, ids (array of int), decoded (the text that the ids give back)."""
    return _run(docs, model, id_col, text_col, False)


def digests(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = SLICE_BYTES, keep_words: bool = True) -> DataFrame:
    """encode() with its arrays and texts only as digests, taken in the worker: doc_id, n_tokens, ids_sha256, decoded_sha256. slice_bytes: text at a time; a byte takes about 60 bytes of a worker's memory, and smaller slices share fewer words. keep_words: whether a worker remembers words from one task to the next, and their memory between jobs."""
    return _run(docs, model, id_col, text_col, True, slice_bytes, keep_words)


def _run(docs: DataFrame, model: str, id_col: str, text_col: str, digest: bool, slice_bytes: int = SLICE_BYTES, keep_words: bool = True) -> DataFrame:
    small_batches(docs.sparkSession)
    rows = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] if digest else ["doc_id", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        try:
            yield from coded(c, batches)
        finally:
            if not keep_words:
                c.known, c.old = {}, {}

    def coded(c: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pc.fill_null(b.column(1), "")
            for i, j in slices(text, slice_bytes):
                table, texts = c.encode_batch(text.slice(i, j - i).to_pylist())
                n_ids, spelt, surface = ([x[k] for x in table] for k in range(3))
                out: list[list] = [[] for _ in names[1:]]
                lens = np.array(n_ids, np.int64)
                for codes in texts:
                    own = codes.tolist()
                    back = "".join([surface[k] for k in own])[1:]  # the first chunk starts with the added marker
                    if digest:
                        out[0].append(int(lens[codes].sum()) if own else 0)
                        out[1].append(hashlib.sha256(b",".join([spelt[k] for k in own])).hexdigest())
                        out[2].append(hashlib.sha256(back.encode()).hexdigest())
                    else:
                        out[0].append([int(i) for k in own for i in spelt[k].split(b",")])
                        out[1].append(back)
                kinds = [pa.int64(), pa.string(), pa.string()] if digest else [pa.list_(pa.int32()), pa.string()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(x, t) for x, t in zip(out, kinds, strict=True)]], names)

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"doc_id {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "ids array<int>, decoded string"))
