"""Byte-level BPE encoding and decoding with a pair occurrence index.

The new distinct words of a batch are laid out as one linked list of symbols.
An index maps each mergeable pair to all its positions; active ranks are taken
in ascending order, each is applied to all its positions in one vector step, and
only the lists of the pairs that this creates are extended.  A merge of rank r
makes a token that only later ranks use, hence ascending order over the whole
batch gives every word what greedy merging gives it alone (`Vocabulary` checks
this property of the file and refuses others).

Spark deals the documents; a task keeps the codes of the words it has met, at
most ``CACHE_WORDS`` of them.  Whole texts are encoded and nothing is shuffled.

Defined cases: a null text is encoded as the empty text, which has no tokens;
the text of a special token becomes that token; long texts and repeated rows change
nothing; extra columns with the name of an output are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from murmuration.llm import kernel

CACHE_WORDS, SLICE_BYTES = 200_000, 2 << 20

#: The public pre-tokenisation pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in character of each byte, to that byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file of kind byte-level BPE, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, alphabet = spec["model"], byte_alphabet()
        ids = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = max(0, *ids.values(), *self.special.values()) + 1
        self.token_bytes = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int32)
        for char, byte in alphabet.items():
            self.byte_id[byte] = ids[char]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int32)
        self.right = np.array([ids[b] for _, b in pairs], np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        born = np.full(size, -1)
        born[self.made] = np.arange(len(pairs))
        if len(set(self.made.tolist())) < len(pairs) or (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a token of a later merge; ranks can't be applied in order")
        keys = self.left.astype(np.int64) << 32 | self.right
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 where they don't merge."""
        key = left.astype(np.int64) << 32 | right.astype(np.int64) & 0xFFFFFFFF
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.order[at], -1)


def encode_words(vocabulary: Vocabulary, words: list[bytes]) -> list[bytes]:
    """Each word's ids as little-endian unsigned 32-bit integers."""
    if not words:
        return []
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words), np.int64)
    np.cumsum(sizes[:-1] + 1, out=starts[1:])
    total = int(sizes.sum()) + len(words)
    joined = np.frombuffer(b"\0".join(words) + b"\0", np.uint8)
    symbol = vocabulary.byte_id[joined]
    symbol[starts + sizes] = -1  # a stop between words
    after = np.arange(1, total + 1, dtype=np.int32)
    before = np.arange(-1, total - 1, dtype=np.int32)

    index: dict[int, list[np.ndarray]] = defaultdict(list)
    active: list[int] = []

    def enter(at: np.ndarray, rank: np.ndarray) -> None:
        found = rank >= 0
        at, rank = at[found], rank[found]
        if not len(at):
            return
        if len(at) > 1:
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            pieces, heads = np.split(at, cuts), rank[np.concatenate(([0], cuts))].tolist()
        else:
            pieces, heads = [at], rank.tolist()
        for r, piece in zip(heads, pieces, strict=True):
            if r not in index:
                heapq.heappush(active, r)
            index[r].append(piece)

    enter(np.arange(total - 1), vocabulary.ranks(symbol[:-1], symbol[1:]))
    while active:
        r = heapq.heappop(active)
        lists = index.pop(r)
        at = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
        a, b = vocabulary.left[r], vocabulary.right[r]
        at = at[symbol[at] == a]
        at = at[symbol[after[at]] == b]
        if a == b and len(at) > 1:  # in a run of one symbol, every second pair counts from the left
            chained = np.zeros(len(at), bool)
            chained[1:] = after[at[:-1]] == at[1:]
            n = np.arange(len(at))
            at = at[(n - np.maximum.accumulate(np.where(chained, 0, n))) % 2 == 0]
        if not len(at):
            continue
        gone = after[at]
        following = after[gone]
        symbol[at], symbol[gone] = vocabulary.made[r], -2
        after[at], before[following] = following, at
        prior = before[at]
        inner = prior >= 0
        enter(
            np.concatenate((prior[inner], at)),
            vocabulary.ranks(np.concatenate((symbol[prior[inner]], symbol[at])), np.concatenate((symbol[at[inner]], symbol[following]))),
        )
    kept = symbol >= 0
    ends = np.cumsum(kept)[starts + sizes]
    flat = symbol[kept].astype("<u4").tobytes()
    bounds = [0, *(ends * 4).tolist()]
    return [flat[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]


class Coder:
    """Encodes and decodes texts; keeps the codes of words it has met."""

    def __init__(self, path: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self.find = regex.compile(PATTERN).findall
        marks = [regex.escape(x) for x in sorted(self.vocabulary.special, key=len, reverse=True)]
        self.special = regex.compile("(" + "|".join(marks) + ")") if marks else None
        self.known: dict[str, bytes] = {}

    def _pieces(self, text: str) -> list[str]:
        if self.special is None or not self.special.search(text):
            return self.find(text)
        out: list[str] = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.find(part)
        return out

    def encode(self, texts: list[str | None]) -> list[bytes]:
        pieces = [self._pieces(t) if t else [] for t in texts]
        new = set().union(*pieces) - self.known.keys()
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = set().union(*pieces)
        special = new & self.vocabulary.special.keys()
        self.known |= {w: np.array([self.vocabulary.special[w]], "<u4").tobytes() for w in special}
        words = list(new - special)
        self.known.update(zip(words, encode_words(self.vocabulary, [w.encode() for w in words]), strict=True))
        code = self.known.__getitem__
        return [b"".join(map(code, p)) for p in pieces]

    def decode(self, ids: bytes) -> str:
        token = self.vocabulary.token_bytes.__getitem__
        return b"".join(map(token, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


FULL = "ids array<int>, decoded string"
DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, path: str, columns: list[str], text: str = "text", digest: bool = False) -> DataFrame:
    """The given columns but those with the name of an output, then the ids and the decoded text, or with `digest` their count and hashes."""
    from pyspark.sql import functions as F

    made_here = T._parse_datatype_string(DIGEST if digest else FULL).fieldNames()
    source = docs.select(*[F.col(f"`{c}`") for c in columns if c not in made_here], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], *T._parse_datatype_string(DIGEST if digest else FULL).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(path)
        for batch in batches:
            for piece in kernel.slices(batch, "__text", SLICE_BYTES):
                codes = coder.encode(piece.column(piece.num_columns - 1).to_pylist())
                kept = [piece.column(i) for i in range(piece.num_columns - 1)]
                if digest:
                    made = [
                        pa.array([len(c) // 4 for c in codes], pa.int64()),
                        pa.array([hashlib.sha256(c).hexdigest() for c in codes], pa.string()),
                        pa.array([hashlib.sha256(coder.decode(c).encode()).hexdigest() for c in codes], pa.string()),
                    ]
                else:
                    made = [pa.array([np.frombuffer(c, "<u4").astype(np.int32) for c in codes], pa.list_(pa.int32())), pa.array([coder.decode(c) for c in codes], pa.string())]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=schema.names)

    return source.mapInArrow(run, schema)
