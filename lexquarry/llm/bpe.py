"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the characters cuts texts into chunks, so that passages which documents share fall into the same
chunks wherever they stand.  A worker encodes a chunk once and uses the result for every document that holds it, as long as its bounded memory reaches.  The
pieces at the two ends of a chunk (up to the next blank) may go on in its neighbours; at each join the piece that
crosses it is encoded anew, over more chunks if need be, until blanks stand on both of its sides.  A token of these
vocabularies never crosses a blank, so the sequence is then exactly that of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .util import column, map_blocks, table, texts

#: Characters that the rolling hash sees, and bits that must be zero for a cut: chunks have 2 ** CUT_BITS characters on average.
WINDOW, CUT_BITS = 16, 10
#: What a worker remembers: pieces, and characters of chunks.
MEMO_PIECES, MEMO_CHARS = 400_000, 8 << 20
_M = np.uint64(0x9E3779B97F4A7C15)


def cuts(text: str) -> list[int]:
    """Ends of the chunks; every cut depends on the WINDOW characters before it alone."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(codes) <= WINDOW:
        return [len(codes)] if len(codes) else []
    with np.errstate(over="ignore"):
        h = (codes.astype(np.uint64) + np.uint64(1)) * _M
        h ^= h >> np.uint64(29)
        step, m = 1, _M
        while step < WINDOW:
            h = h[step:] + m * h[:-step]
            step, m = 2 * step, m * m
        h *= _M
    at = np.flatnonzero(h >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    out = at.tolist()
    return out if out and out[-1] == len(codes) else [*out, len(codes)]


def default_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class ChunkEncoder:
    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.texts = {i: t for t, i in tokenizer.get_vocab().items()}
        self.pieces: dict[str, tuple[int, str, str]] = {}
        self.chunks: dict[str, tuple | None] = {}
        self.held = 0
        self.encoded = self.reused = 0

    def learn(self, pieces: list[str]) -> None:
        """Encode pieces that are not known yet, in one call.

        A full stop or comma after a Latin letter (one that stays a letter in lower case) is always a token of its own, so such a piece is put together from its word's.
        """
        ends = [p for p in pieces if len(p) > 1 and p[-1] in ".," and p[-2] < "\u0250" and p[-2].lower().isalpha()]
        held = set(ends)
        plain = {p for p in pieces if p not in held} | {p[:-1] for p in ends} | ({".", ","} if ends else set())
        words = [p for p in plain if p not in self.pieces]
        tokens = self.texts
        for p, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            ids = e.ids
            self.pieces[p] = (len(ids), " ".join(map(str, ids)), " ".join([tokens[i] for i in ids]))
        for p in ends:
            (n, ids, texts), (m, ids2, texts2) = self.pieces[p[:-1]], self.pieces[p[-1]]
            self.pieces[p] = (n + m, f"{ids} {ids2}", f"{texts} {texts2}")

    def piece(self, p: str) -> tuple[int, str, str]:
        if (found := self.pieces.get(p)) is None:
            self.learn([p])
            found = self.pieces[p]
        return found

    def chunk(self, s: str, split: list[str]) -> tuple | None:
        """(head, tokens, ids, texts, tail): the pieces at the ends, which joins decide, and what lies between; None without a blank."""
        if len(split) == 1:
            return None
        known = self.pieces
        inner = [r for p in split[1:-1] if p and (r := known[p])[0]]
        return split[0], sum([r[0] for r in inner]), " ".join([r[1] for r in inner]), " ".join([r[2] for r in inner]), split[-1]

    def encode(self, docs: list[str]) -> list[tuple[int, str, str]]:
        """For each text the number of tokens, the ids and the token strings, each joined by blanks."""
        if len(self.pieces) > MEMO_PIECES:
            self.pieces.clear()
        if self.held > MEMO_CHARS:
            self.chunks.clear()
            self.held = 0
        parts = [[t[a:b] for a, b in zip([0, *ends], ends)] for t, ends in zip(docs, map(cuts, docs))]
        fresh = {s: s.replace("\n", " ").split(" ") for p in parts for s in p if s not in self.chunks}
        self.encoded += len(fresh)
        self.reused += sum(map(len, parts)) - len(fresh)
        unknown = {w for split in fresh.values() for w in split[1:-1] if w and w not in self.pieces}
        if unknown:
            self.learn(list(unknown))
        for s, split in fresh.items():
            self.chunks[s] = self.chunk(s, split)
            self.held += 3 * len(s)
        return [self.join(p) for p in parts]

    def join(self, parts: list[str]) -> tuple[int, str, str]:
        n, ids, toks, open_piece = 0, [], [], ""
        for s in parts:
            if (c := self.chunks[s]) is None:  # the open piece goes on through this chunk
                open_piece += s
                continue
            if joint := open_piece + c[0]:
                r = self.piece(joint)
                if r[0]:
                    n += r[0]
                    ids.append(r[1])
                    toks.append(r[2])
            if c[1]:
                n += c[1]
                ids.append(c[2])
                toks.append(c[3])
            open_piece = c[4]
        if open_piece and (r := self.piece(open_piece))[0]:
            n += r[0]
            ids.append(r[1])
            toks.append(r[2])
        return n, " ".join(ids), " ".join(toks)


_ENCODERS: dict[str | None, ChunkEncoder] = {}


def encoder_of(path: str | None) -> ChunkEncoder:
    """A worker's encoder; it stays for the tasks to come."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(load(path))
    return _ENCODERS[path]


#: What the joins count on.  Blanks end every piece, and signs are no part of a word.
NORMALISERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class UnknownLayout(ValueError):
    """A vocabulary whose pieces may cross blanks, or that decodes otherwise: joins could not be repaired."""


def check_layout(spec: dict) -> None:
    """Raise :class:`UnknownLayout` unless the tokenizer's file describes what chunks and joins are made for."""
    cut = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    fits = (
        spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and spec.get("decoder") is None and spec.get("post_processor") is None
        and (spec.get("normalizer") or {}).get("normalizers") == NORMALISERS
        and len(cut) == 2 and cut[0].get("pattern") == {"Regex": SPLIT} and (cut[0].get("behavior"), cut[0].get("invert")) == ("Removed", True)
        and cut[1].get("type") == "ByteLevel" and not cut[1].get("add_prefix_space") and not cut[1].get("use_regex")
        and not any(" " in a["content"] or a.get("lstrip") or a.get("rstrip") for a in spec.get("added_tokens", []))
    )
    if not fits:
        raise UnknownLayout("chunk reuse is laid out for word-level BPE vocabularies that split at blanks and have no decoder")


def load(path: str | None):
    """The tokenizer, without truncation and padding; files of another layout are refused."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    path = path or default_path()
    with open(path, encoding="utf-8") as f:
        check_layout(json.load(f))
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def _over(docs: DataFrame, added: str, fill: Callable[[list[tuple[int, str, str]]], dict], path: str | None, text: str) -> DataFrame:
    kinds = T._parse_datatype_string(added)
    base = docs.drop(*kinds.names)
    names = base.columns

    def make():
        encoder = encoder_of(path)

        def work(block):
            return {f: column(block, f) for f in names} | fill(encoder.encode([t or "" for t in texts(block, text)]))

        return work

    return map_blocks(base, make, T.StructType(base.schema.fields + kinds.fields), weigh=text)


def encode(docs: DataFrame, *, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_tokens and ids (array of int).

    Equal to the tokenizers library's encoding of each whole text without special tokens added.  A null text counts as
    empty; empty and blank texts have no ids.  ``path`` is the vocabulary on the workers (default: that of the public
    49k word vocabulary).  Columns of docs with the added names are replaced.
    """
    return _over(docs, "n_tokens long, ids array<int>", lambda rs: {"n_tokens": [n for n, _, _ in rs], "ids": [[int(x) for x in s.split()] for _, s, _ in rs]}, path, text)


def decode(docs: DataFrame, *, path: str | None = None, ids: str = "ids") -> DataFrame:
    """docs with decoded: the tokens joined by blanks, which is what this vocabulary, having no decoder, decodes to."""
    base = docs.drop("decoded")
    names = base.columns

    def make():
        t = load(path)

        def work(block):
            return {f: column(block, f) for f in names} | {"decoded": [t.decode(x or [], skip_special_tokens=False) for x in column(block, ids).to_pylist()]}

        return work

    return map_blocks(base, make, T.StructType(base.schema.fields + [T.StructField("decoded", T.StringType())]), weigh=None)


def digests(docs: DataFrame, *, path: str | None = None, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, encoded and decoded in one pass, without moving the ids."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return _over(docs, "n_tokens long, ids_sha256 string, decoded_sha256 string", lambda rs: {"n_tokens": [n for n, _, _ in rs], "ids_sha256": [sha(s) for _, s, _ in rs], "decoded_sha256": [sha(s) for _, _, s in rs]}, path, text)


def op5_bpe_chunks(spark, sf_dir: str) -> DataFrame:
    """:func:`digests` of ``documents``: doc_id, n_tokens, ids_sha256, decoded_sha256; a null text counts as empty."""
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
