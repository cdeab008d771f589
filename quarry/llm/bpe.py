"""Operator 3: byte-level BPE encoding and decoding by forced-boundary splitting.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can never be merged over, so a cut
between the two is certain. Every pre-token is cut at such pairs, the fragments are encoded independently of
each other, and their ids are concatenated. New fragments of many texts go to the library in one call, set apart by signs
that no fragment holds. Pieces of text repeat far more often than texts, so each worker keeps the ids of those it has met in
two generations of at most ``generation`` pieces (this bounds memory, never the result). The text is decoded from the ids.

Edge cases: a null text is the empty text, which has no ids and decodes to the empty text; special tokens inside
a text become their single ids, as the tokenizers library does by default; texts of any length are encoded whole;
repeated rows and repeated or null ids of documents give a row each; columns other than the key and the text are
not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import arrow_map, table, text_of

#: Fixed: the pre-token pattern of byte-level BPE vocabularies of this kind.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Signs that end many words and, without an apostrophe, are a pre-token of their own behind letters.
SIGNS = ".,;:!?*$%&#|\"()[]{}<>=+-_/@"
#: White space other than single blanks and line feeds between other characters.
UNEVEN = ("  ", "\n\n", " \n", "\n ", *"\0\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0     　", *map(chr, range(0x2000, 0x200B)))
#: What separates fragments, and what marks a cut inside one.
APART, CUT = "\n", "\t"
#: Characters of texts that are worked on together: enough for calls in bulk, few enough to stay in a processor's cache.
BLOCK = 100_000


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it prints, else the next one from U+0100."""
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


class BulkEncoder:
    """Ids of many fragments of bytes in one call of the tokenizers library.

    The fragments go in as one string in which ``APART`` stands between them and ``CUT`` at certain cuts inside them: no merge
    reaches over either. The ids come back as one list. It falls into the fragments' at the ids of ``APART``, or, where the model marks the
    ends of words, at tokens with that mark.
    """

    def __init__(self, model: dict, cuts: np.ndarray | None = None) -> None:
        """``cuts``: for each pair of bytes, as ``256 * first + second``, whether a cut between the two is certain."""
        from tokenizers import Tokenizer, pre_tokenizers
        from tokenizers.models import BPE

        suffix = model.get("end_of_word_suffix") or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        n = max(model["vocab"].values()) + 1
        self.apart, self.cut = n, n + 1
        # A cache of its own would only keep what callers keep already.
        options = {"end_of_word_suffix": suffix} if suffix else {}
        self.library = Tokenizer(BPE(vocab=model["vocab"] | {APART: self.apart, CUT: self.cut}, merges=merges, cache_capacity=0, **options))
        self.library.pre_tokenizer = pre_tokenizers.Split(APART, "removed" if suffix else "merged_with_previous")
        self.ends = np.zeros(n, bool) if suffix else None
        if suffix:
            self.ends[[i for token, i in model["vocab"].items() if token.endswith(suffix)]] = True
        self.letters = np.array([ord(c) for c in byte_alphabet()], "<u4")
        self.cuts = None
        if cuts is not None and not suffix:
            self.cuts = cuts.copy()
            self.cuts[[256 * b + ord(APART) for b in range(256)]] = self.cuts[[256 * ord(APART) + b for b in range(256)]] = False

    def __call__(self, fragments: list[str], width: str) -> list[bytes]:
        """The ids of each fragment as bytes. Fragments hold no line feed and no tab and are not empty."""
        raw = np.frombuffer(APART.join(fragments).encode(), np.uint8)
        signs = self.letters[raw]
        signs[raw == ord(APART)] = ord(APART)
        if self.cuts is not None:
            at = np.flatnonzero(self.cuts[raw[:-1].astype(np.int64) * 256 + raw[1:]]) + 1
            signs = np.insert(signs, at, ord(CUT)) if len(at) else signs
        ids = np.array(self.library.encode_batch_fast([signs.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, np.int64)
        size = np.dtype(width).itemsize
        if self.ends is not None:
            last = np.flatnonzero(self.ends[ids]) + 1
            first = np.concatenate([[0], last[:-1]])
        else:
            ids = ids[ids != self.cut]
            last = np.append(np.flatnonzero(ids == self.apart), len(ids))
            first = np.concatenate([[0], last[:-1] + 1])
        if len(last) != len(fragments):
            raise ValueError("the ids do not fall into as many parts as there are fragments")
        flat = ids.astype(width).tobytes()
        return [flat[a:b] for a, b in zip((first * size).tolist(), (last * size).tolist(), strict=True)]


class TwoGenerations:
    """What is known of pieces: those met lately are young; when there are too many of them the old ones go."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def missing(self, pieces: set[str]) -> list[str]:
        """The pieces not known; afterwards all others are young."""
        new = pieces.difference(self.young)
        if len(self.young) + len(new) > self.size:
            self.old, self.young = self.young, {}
            new = pieces
        if self.old and new:
            again = {p: self.old[p] for p in new if p in self.old}
            self.young.update(again)
            new = new.difference(again)
        return list(new)


def encode_pieces(cut: list[list[str]], known: TwoGenerations, learn: Callable[[list[str]], None]) -> list[bytes]:
    """The ids of texts given as pieces; ``learn`` is called for those that are not known, all together."""
    if new := known.missing(set().union(*cut)):
        learn(new)
    of = known.young.__getitem__
    return [b"".join(map(of, pieces)) for pieces in cut]


def in_blocks(texts: Iterable[str], most: int = BLOCK) -> Iterator[list[str]]:
    """Texts in their order, together as long as they have ``most`` characters at most; a longer one is alone."""
    block: list[str] = []
    size = 0
    for t in texts:
        if block and size + len(t) > most:
            yield block
            block, size = [], 0
        block.append(t)
        size += len(t)
    if block:
        yield block


class ForcedBoundaryBPE:
    """Encodes and decodes with the vocabulary and merges of one tokenizer file."""

    def __init__(self, path: str, generation: int = 300_000) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        of_char = {c: b for b, c in enumerate(byte_alphabet())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(of_char[c] for c in token) for token, i in vocab.items() if token not in self.special}
        self.bytes_of |= {i: content.encode() for content, i in self.special.items()}
        cuts = np.ones(1 << 16, bool)
        for i, b in self.bytes_of.items():
            if i not in self.special.values():
                cuts[[256 * x + y for x, y in zip(b, b[1:], strict=False)]] = False
        self.cuts = cuts
        n = max(self.bytes_of) + 1
        self.width = "<u2" if n <= 1 << 16 else "<u4"
        self.encode_fragments = BulkEncoder(spec["model"], cuts)
        self.pre_token = regex.compile(PRE_TOKEN)
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known = TwoGenerations(generation)
        self.signs: dict[str, bytes] = {"": b""}
        #: By id: its decimals with a comma; its bytes, filled up with a byte that no UTF-8 text holds; whether they are too many for that.
        self.decimals = np.array([b"%d," % i for i in range(n)], f"S{len(str(n)) + 1}")
        self.filled = np.full((n, 16), 0xFF, np.uint8)
        self.too_long = np.zeros(n, bool)
        for i, b in self.bytes_of.items():
            self.filled[i, : len(b)] = np.frombuffer(b[:16], np.uint8)
            self.too_long[i] = len(b) > 16 or 0xFF in b
        self.filled = self.filled.view("V16").ravel()

    def pieces(self, text: str) -> list[str]:
        """Parts of a text that begin and end where pre-tokens do.

        Where white space is single blanks and line feeds between other characters, a pre-token begins at each
        blank, and a line feed is one of its own; elsewhere the pre-token pattern itself deals out the text.
        """
        if any(map(text.__contains__, UNEVEN)) or text[:1].isspace() or text[-1:].isspace():
            return self.pre_token.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def learn(self, new: list[str]) -> None:
        """Ids of new pieces: of a word and the signs behind it, or else of all pre-tokens of the piece."""
        named, bodies, tails, rest = [], [], [], []
        for p in new:
            body = p.rstrip(SIGNS)
            if p in self.special:
                self.known.young[p] = np.array([self.special[p]], self.width).tobytes()
            elif body.isalpha() or (body[:1] == " " and body[1:].isalpha()):
                named.append(p)
                bodies.append(body)
                tails.append(p[len(body) :])
            else:
                rest.append((p, self.pre_token.findall(p)))
        if len(self.signs) > 10_000:
            self.signs = {"": b""}
        ends = set(tails).difference(self.signs)
        wanted = list({*bodies, *ends, *(t for _, found in rest for t in found if "\n" not in t and "\t" not in t)})
        ids = dict(zip(wanted, self.encode_fragments(wanted, self.width), strict=True)) if wanted else {}
        self.signs.update((t, ids[t]) for t in ends)
        young, signs = self.known.young, self.signs
        for p, body, tail in zip(named, bodies, tails, strict=True):
            young[p] = ids[body] + signs[tail]
        for p, found in rest:
            young[p] = b"".join([ids[t] if t in ids else self._blank(t) for t in found])

    def _blank(self, pre_token: str) -> bytes:
        """Ids of a pre-token of white space that holds a sign set apart: it goes to the model by itself."""
        signs = self.encode_fragments.letters[np.frombuffer(pre_token.encode(), np.uint8)].tobytes().decode("utf-32-le")
        return np.array([t.id for t in self.encode_fragments.library.model.tokenize(signs)], self.width).tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as bytes."""
        out: list[bytes] = []
        for block in in_blocks(texts):
            cut = []
            for t in block:
                if self.at_special and any(map(t.__contains__, self.special)):
                    cut.append([p for part in self.at_special.split(t) if part for p in ([part] if part in self.special else self.pieces(part))])
                else:
                    cut.append(self.pieces(t) if t else [])
            out += encode_pieces(cut, self.known, self.learn)
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], self.width).tolist()

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        if self.too_long[ids].any():
            return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        return self.filled[ids].tobytes().translate(None, b"\xff")

    def decode(self, ids: list[int]) -> str:
        """What ids decode to; ids beyond the vocabulary decode to nothing."""
        return b"".join(self.bytes_of.get(i, b"") for i in ids).decode("utf-8", "replace")

    def digest(self, encoded: bytes) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, and SHA-256 of the text that the ids decode to."""
        ids = np.frombuffer(encoded, self.width)
        decimals = self.decimals[ids].tobytes().translate(None, b"\0")[:-1]
        back = self.decode_bytes(ids).decode("utf-8", "replace").encode()
        return len(ids), hashlib.sha256(decimals).hexdigest(), hashlib.sha256(back).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str) -> ForcedBoundaryBPE:
    """One codec a worker process and file."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ForcedBoundaryBPE(path)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("key"), text_of(text).alias("text"))


def encode_documents(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>``: the ids of every whole text."""

    def make():
        bpe = codec(tokenizer_path)

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.frombuffer(x, bpe.width).astype(np.int32) for x in bpe.encode_all(b.column(1).to_pylist())]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    return arrow_map(_keyed(docs, key, text), make, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


def decode_documents(encoded: DataFrame, tokenizer_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text``: what the ids decode to; null ids decode to the empty text."""

    def make():
        bpe = codec(tokenizer_path)
        return lambda b: pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["key", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    return arrow_map(encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids")), make, f"key {kind}, text string").withColumnRenamed("key", key)


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of every whole text, encoded and decoded in one pass."""

    def make():
        bpe = codec(tokenizer_path)

        def each(b: pa.RecordBatch) -> pa.RecordBatch:
            n, ids, back = zip(*map(bpe.digest, bpe.encode_all(b.column(1).to_pylist())), strict=True)
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])

        return each

    kind = docs.schema[key].dataType.simpleString()
    out = arrow_map(_keyed(docs, key, text), make, f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
