"""Byte-level BPE, encoding and decoding, with a pair occurrence index.

Texts are cut by the tokenizer's pattern. The different pieces of an Arrow batch are laid out as one chain of byte
symbols; an index maps every mergeable pair to all its positions there. Ranks that have positions are applied in
ascending order, each at all its positions from left to right, and the lists of the neighbouring pairs are extended.
A merge only makes pairs of higher rank, so this equals merging piece by piece. Pieces stay in a table for the next
batches of the partition.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from phraselens.llm.common import shared

TABLE_PIECES = 100_000      # pieces in each half of the memory between slices; forgetting them costs time only
SLICE = 400                 # texts cut and merged at a time


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else 256 onwards."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """What a byte-level tokenizer file says: bytes of every id, merges by rank, special strings."""

    # Fixed value: the pattern of the byte-level pre-tokenizer. White space is spelled out: engines differ on it.
    SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
    PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^" + SPACE + r"\p{L}\p{N}]+|["
               + SPACE + r"]+(?![^" + SPACE + r"])|[" + SPACE + r"]+")

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern = self.PATTERN
        model, alphabet = spec["model"], byte_alphabet()
        byte_of = {c: b for b, c in enumerate(alphabet)}
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (1 + max([*ids.values(), *self.special.values()]))
        for token, i in ids.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.byte_ids = [ids[c] for c in alphabet]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = [(ids[a], ids[b], ids[a + b]) for a, b in pairs]


def merge_all(pieces: list[bytes], vocabulary) -> list[bytes]:
    """The ids of each piece, as little-endian 32-bit numbers.

    Positions of the pairs of single bytes are found for all pieces at once; from then on the index is updated merge by merge.
    """
    letters = np.frombuffer(b"".join(pieces), np.uint8)
    ends = np.cumsum([len(p) for p in pieces])
    symbols, ranks, merges = vocabulary.byte_ids[letters].tolist(), vocabulary.ranks, vocabulary.merges
    following, before = np.arange(1, len(letters) + 1), np.arange(-1, len(letters) - 1)
    following[ends - 1] = -1
    before[np.append(0, ends[:-1])] = -1
    first = vocabulary.byte_ranks[letters[:-1], letters[1:]]
    first[ends[:-1] - 1] = -1                           # no pair across pieces
    held = np.flatnonzero(first >= 0)
    held = held[np.argsort(first[held], kind="stable")]
    cuts = np.flatnonzero(np.diff(first[held], prepend=-1))
    where = dict(zip(first[held[cuts]].tolist(), (p.tolist() for p in np.split(held, cuts[1:])))) if len(held) else {}
    following, before = following.tolist(), before.tolist()
    active = list(where)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        left, right, joined = merges[rank]
        for i in sorted(where.pop(rank)):
            j = following[i]
            if symbols[i] != left or j < 0 or symbols[j] != right:
                continue        # a symbol went into an earlier merge
            symbols[i], symbols[j] = joined, -1
            following[i] = after = following[j]
            if after >= 0:
                before[after] = i
                if (new := ranks.get(joined << 32 | symbols[after])) is not None:
                    if new in where:
                        where[new].append(i)
                    else:
                        where[new] = [i]
                        heapq.heappush(active, new)
            a = before[i]
            if a >= 0 and (new := ranks.get(symbols[a] << 32 | joined)) is not None:
                if new in where:
                    where[new].append(a)
                else:
                    where[new] = [a]
                    heapq.heappush(active, new)
    left_over = np.array(symbols, np.int64)
    stays = left_over >= 0
    ids, places = left_over[stays].astype("<u4").tobytes(), [0, *(np.cumsum(stays)[ends - 1] * 4).tolist()]
    return [ids[a:b] for a, b in zip(places, places[1:])]


class Memory(dict):
    """Ids of pieces seen before. When the newer half is full it becomes the older one; what is asked for moves back."""

    def __init__(self):
        super().__init__()
        self.older: dict[str, bytes] = {}

    def missing(self, pieces: set[str]) -> list[str]:
        """The pieces whose ids are not known; room is made first."""
        if len(self) > TABLE_PIECES:
            self.older = dict(self)
            self.clear()
        new = pieces.difference(self)
        back = new.intersection(self.older)
        self.update((p, self.older[p]) for p in back)
        return list(new - back)


def _encoder(sent):
    def encode(batches):
        vocabulary = sent.value
        vocabulary.byte_ids = np.array(vocabulary.byte_ids)
        vocabulary.ranks = {a << 32 | b: r for r, (a, b, _) in enumerate(vocabulary.merges)}
        vocabulary.byte_ranks = np.array([[vocabulary.ranks.get(int(a) << 32 | int(b), -1) for b in vocabulary.byte_ids] for a in vocabulary.byte_ids])
        find = regex.compile(vocabulary.pattern).findall
        special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")"
                                if vocabulary.special else "(?!)()")
        special_ids = {t: np.array([i], "<u4").tobytes() for t, i in vocabulary.special.items()}
        table = Memory()
        for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
            cut = []
            for text in batch["text"].to_pylist():
                parts = special.split(text or "") if any(t in (text or "") for t in special_ids) else [text or ""]
                cut.append([find(part) if k % 2 == 0 else part for k, part in enumerate(parts)])
            new = table.missing({p for doc in cut for part in doc if isinstance(part, list) for p in part})
            if new:
                table.update(zip(new, merge_all([p.encode() for p in new], vocabulary)))
            ids = [b"".join(special_ids[part] if isinstance(part, str) else b"".join(map(table.__getitem__, part))
                            for part in doc) for doc in cut]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])
    return encode


def _decoder(sent):
    def decode(batches):
        bytes_of = sent.value.bytes_of
        for batch in batches:
            texts = [b"".join(map(bytes_of.__getitem__, np.frombuffer(x or b"", "<u4").tolist())).decode("utf-8", "replace")
                     for x in batch["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["ids"], pa.array(texts, pa.string())],
                                             ["doc_id", "ids", "decoded"])
    return decode


def encode(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, ids for a table with doc_id and text; other columns are ignored, every row gives one row.

    ids holds the token ids as little-endian unsigned 32-bit numbers; a null or empty text gives none. Special strings
    of the vocabulary become their ids. The vocabulary, of fixed size, is read on the driver and broadcast.
    """
    sent = shared(documents.sparkSession, Vocabulary(path))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(_encoder(sent), f"doc_id {kind}, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, decoded; bytes that are not UTF-8 become U+FFFD, special ids their strings."""
    sent = shared(encoded.sparkSession, Vocabulary(path))
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(sent), f"doc_id {kind}, ids binary, decoded string")


def round_trip(documents: DataFrame, path: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids) of every text encoded and decoded again."""
    sent = shared(documents.sparkSession, Vocabulary(path))
    kind = documents.schema["doc_id"].dataType.simpleString()

    def both(batches):      # in one worker, not in two
        return _decoder(sent)(_encoder(sent)(batches))
    made = documents.select("doc_id", "text").mapInArrow(both, f"doc_id {kind}, ids binary, decoded string")
    return made.select(
        "doc_id", *(["ids"] if keep_ids else []), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
