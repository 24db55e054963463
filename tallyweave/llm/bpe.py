"""Byte-level BPE: exact encoding by dynamic programming over prefixes, and decoding.

The merged form of every prefix of a piece ends in one well-defined last token.
For each end position an automaton over the vocabulary gives all tokens that are
suffixes of the prefix; the right one is the only one that may follow the last
token of what stands before it. Following the stored tokens back from the end
gives the ids that merging by rank would give, in time linear in the length.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the public pattern by which byte-level vocabularies of this kind cut text into pieces.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A tokenizer file above this size is refused: it is broadcast to every executor.
MAX_FILE_BYTES = 64 << 20
#: Most pieces, and most words, that a Python worker remembers; later ones are encoded anew each time.
_CACHE = 200_000


def byte_symbols() -> dict[str, int]:
    """The visible character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Recent:
    """A bounded memory of two generations: what is asked for again outlives the change."""

    def __init__(self, most: int):
        self.most = most
        self.now: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def put(self, key: str, value: bytes) -> bytes:
        if len(self.now) >= self.most // 2:
            self.before = dict(self.now)
            self.now.clear()
        self.now[key] = value
        return value

    def old(self, key: str) -> bytes | None:
        value = self.before.get(key)
        return value and self.put(key, value)


class ByteBPE:
    """Encoder and decoder for one tokenizer file (the JSON text of a byte-level BPE) that remembers at most ``most`` pieces and as many words."""

    def __init__(self, text: str, most: int | None = None):
        self.most = most or _CACHE
        spec = json.loads(text)
        model, symbols = spec["model"], byte_symbols()
        to_bytes = lambda s: bytes(symbols[c] for c in s)
        self.bytes: dict[int, bytes] = {i: to_bytes(s) for s, i in model["vocab"].items()}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = dict.fromkeys(self.bytes, -1)
        vocab = model["vocab"]
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            new = vocab[left + right]
            self.merge[vocab[left], vocab[right]] = rank
            self.parts[new] = (vocab[left], vocab[right])
            self.rank[new] = rank
        self.special = {}
        for token in spec.get("added_tokens") or []:
            if token.get("single_word") or token.get("lstrip") or token.get("rstrip"):
                raise ValueError(f"added token {token['content']!r}: only plain matching is supported")
            self.special[token["content"]] = token["id"]
            self.bytes[token["id"]] = token["content"].encode()
        #: Tokens that stand for their own bytes, by these bytes (as Latin-1 text).
        self.whole = {self.bytes[i].decode("latin-1"): i for i in self.rank if self._is_whole(i)}
        self.suffixes = ahocorasick.Automaton()
        for s, i in self.whole.items():
            self.suffixes.add_word(s, (len(s), i))
        self.suffixes.make_automaton()
        self.may_follow: dict[int, bool] = {}
        self.table = [self.bytes.get(i, b"") for i in range(max(self.bytes) + 1)]
        self.known, self.words = _Recent(self.most), _Recent(self.most)
        self.pieces = regex.compile(PIECES).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def _boundary_holds(self, x: int, y: int, limit: int) -> bool:
        """True if no merge across the boundary of x|y comes before ``limit``.

        The later of the two formations is undone step by step. What then
        touches at the boundary could merge across it only before the undone
        one; equal ranks run from left to right.
        """
        rank, merge, parts = self.rank, self.merge, self.parts
        while True:
            r = merge.get((x, y))
            if r is not None and r < limit:
                return False
            rx, ry = rank[x], rank[y]
            if rx > ry:
                limit, x = rx, parts[x][1]
            elif ry >= 0:
                limit, y = ry + 1, parts[y][0]
            else:
                return True

    def _is_whole(self, token: int) -> bool:
        """True if the bytes of ``token`` alone encode to ``token``."""
        if self.rank[token] < 0:
            return len(self.bytes[token]) == 1
        a, b = self.parts[token]
        return self._boundary_holds(a, b, self.rank[token])

    def _follows(self, before: int, token: int) -> bool:
        pair = before << 24 | token
        ok = self.may_follow.get(pair)
        if ok is None:
            if len(self.may_follow) >= 2 * self.most:
                self.may_follow.clear()
            ok = self.may_follow[pair] = self._boundary_holds(before, token, 1 << 62)
        return ok

    def _encode_piece(self, piece: str) -> bytes:
        raw = piece if piece.isascii() else piece.encode().decode("latin-1")
        n = len(raw)
        last, sizes = [-1] * n, [0] * n
        for end, (size, token) in self.suffixes.iter(raw):  # the longest suffix first
            if last[end] < 0 and (size > end or last[end - size] >= 0 and self._follows(last[end - size], token)):
                last[end], sizes[end] = token, size
        ids, at = [], n - 1
        while at >= 0:
            ids.append(last[at])
            at -= sizes[at]
        return array("i", ids[::-1]).tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self._encode_piece(piece)
        return self.known.put(piece, ids) if len(piece) <= 24 else ids

    def _plain(self, text: str) -> bytes:
        known = self.known.now.get
        return b"".join([known(p) or self.known.old(p) or self._piece(p) for p in self.pieces(text)])

    def _word(self, word: str) -> bytes:
        """Ids of a word and the one space before it; such a space always starts a piece."""
        if not word or word[-1].isspace():
            raise _SpaceRun
        ids = self.words.old(word)
        if not ids:
            spaced = f" {word}"
            ids = self._encode_piece(spaced) if word.isalpha() else self._plain(spaced)
            if len(word) <= 24 and "\n" not in word:
                self.words.put(word, ids)
        return ids

    def _text(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        known = self.words.now.get
        try:
            if rest and (not first or first[-1].isspace()):
                raise _SpaceRun
            return self._plain(first) + b"".join([known(w) or self._word(w) for w in rest])
        except _SpaceRun:  # longer runs of white space are cut with what surrounds them in view
            return self._plain(text)

    def forget(self) -> None:
        """Let go of remembered pieces and words: a worker lives on into stages that need its memory."""
        self.known, self.words = _Recent(self.most), _Recent(self.most)

    def encode(self, text: str) -> bytes:
        """Token ids (native int32) of a whole text; the strings of added tokens become those tokens."""
        if self.cut is None or not any(s in text for s in self.special):
            return self._text(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += [self._text(text[at : m.start()]), array("i", [self.special[m[0]]]).tobytes()]
            at = m.end()
        return b"".join([*out, self._text(text[at:])])

    def decode(self, ids: list[int]) -> str:
        """Text of token ids, added tokens included; ids outside the vocabulary give nothing."""
        table = self.table
        try:
            if ids and min(ids) < 0:
                raise IndexError
            raw = b"".join(map(table.__getitem__, ids))
        except IndexError:
            raw = b"".join(table[i] for i in ids if 0 <= i < len(table))
        return raw.decode("utf-8", "replace")


class _SpaceRun(Exception):
    pass


_LOADED: dict[int, ByteBPE] = {}


def _loaded(shared, most: int | None = None) -> ByteBPE:
    """One encoder per Python worker; the file's text comes by broadcast."""
    if shared.value[0] not in _LOADED:
        _LOADED.clear()
        _LOADED[shared.value[0]] = ByteBPE(shared.value[1], most)
    return _LOADED[shared.value[0]]


def broadcast_tokenizer(spark, path: str):
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE_BYTES + 1)
    if len(text) > MAX_FILE_BYTES:
        raise ValueError(f"{path} is larger than {MAX_FILE_BYTES} bytes")
    return spark.sparkContext.broadcast((hash(text), text))


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def _encoded(batches, shared, text_col: str, names: list[str], ids_col: str, lean: bool) -> Iterator[pa.RecordBatch]:
    """The columns ``names`` and token ids of every batch."""
    bpe = _loaded(shared, _CACHE // 4 if lean else None)
    try:
        for whole in batches:
            for batch in _slices(whole):
                texts = batch.column(text_col).to_pylist()
                found = [bpe.encode(t) if t else b"" for t in texts]
                ends = np.cumsum([0, *map(len, found)], dtype=np.int64) // 4
                values = np.frombuffer(b"".join(found), np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids], names=[*names, ids_col])
    finally:
        bpe.forget()
        if lean:
            _LOADED.clear()


def encode_documents(
    df: DataFrame, tokenizer_path: str, *, text_col: str = "text", ids_col: str = "token_ids", keep_text: bool = True, lean: bool = False
) -> DataFrame:
    """Add ``ids_col`` (array<int>): the token ids of every whole text, no special tokens added.

    Without ``keep_text`` the texts themselves are not sent back from Python.
    With ``lean`` a worker remembers a quarter of the pieces and words and lets
    go of the encoder after each task, for sessions that run other stages too.

    Null text encodes like the empty text, to an empty array. Texts of any
    length are encoded whole, in time linear in their length. Row order and
    repeated rows stay; an empty table gives an empty table. An input column
    named ``ids_col`` is replaced. The tokenizer file is read on the driver
    and broadcast (at most 64 MB).
    """
    shared = broadcast_tokenizer(df.sparkSession, tokenizer_path)
    df = df.drop(ids_col)
    kept = [f for f in df.schema.fields if keep_text or f.name != text_col]
    schema = T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType(), False), False)])

    names = [f.name for f in kept]
    return df.mapInArrow(lambda batches: _encoded(batches, shared, text_col, names, ids_col, lean), schema)


def decode_documents(df: DataFrame, tokenizer_path: str, *, ids_col: str = "token_ids", text_col: str = "decoded") -> DataFrame:
    """Add ``text_col``: the text of every row's token ids, added tokens included. Null ids give the empty text."""
    shared = broadcast_tokenizer(df.sparkSession, tokenizer_path)
    df = df.drop(text_col)
    schema = T.StructType([*df.schema.fields, T.StructField(text_col, T.StringType(), False)])

    def run(batches):
        bpe = _loaded(shared)
        for whole in batches:
            for batch in _slices(whole):
                ids = batch.column(ids_col)
                offsets = ids.offsets.to_numpy() - ids.offsets[0].as_py() if batch.num_rows else []
                flat = ids.flatten().to_numpy(zero_copy_only=False).tolist()
                if ids.null_count:
                    texts = [bpe.decode(x or []) for x in ids.to_pylist()]
                else:
                    texts = [bpe.decode(flat[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, text_col])

    return df.mapInArrow(run, schema)


def token_digests(df: DataFrame, tokenizer_path: str) -> DataFrame:
    """Per document: number of tokens, SHA-256 of the decimal ids, SHA-256 of the decoded text."""
    docs = df.select("doc_id", "text")
    coded = decode_documents(encode_documents(docs, tokenizer_path, keep_text=False), tokenizer_path)
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
