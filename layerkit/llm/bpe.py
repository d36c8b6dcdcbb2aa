"""Operator 9: byte-pair encoding and decoding by an index of pair occurrences.

The distinct words of a block of texts become one array of symbols with links
to the neighbours that are left. An index maps the rank of each pair to all its
positions. The lowest active rank is applied at all its positions at once, and
only the pairs that touch a merged place enter the index anew.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from layerkit.llm.common import begin, blocks, remember
from layerkit.llm.tokens import default_tokenizer

# Chunks held in memory per process.
_MEMORY = 400_000


# Letters and numbers that Unicode 16 added, and the pairs of upper and
# lower case that Unicode 16 and 17 added. The tokenizers library knows them, and this
# Python's tables (Unicode 15) do not.
NEW_LETTERS = """1c89-1c8a a7cb-a7cd a7da-a7dc 105c0-105f3 10d4a-10d65 10d6f-10d85 10ec2-10ec4 11380-11389 1138b 1138e
    11390-113b5 113b7 113d1 113d3 11bc0-11be0 13460-143fa 16100-1611d 16d40-16d6c 18cff 1e5d0-1e5ed 1e5f0"""
NEW_NUMBERS = "10d40-10d49 116d0-116e3 11bf0-11bf9 16130-16139 16d70-16d79 1ccf0-1ccf9 1e5f1-1e5fa"
NEW_LOWER = {
    0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B,
    **{c: c + 0x20 for c in range(0x10D50, 0x10D66)}, **{c: c + 0x1B for c in range(0x16EA0, 0x16EB9)},
}


@cache
def character_class(kind: str) -> str:
    """Members of the letters (L) or numbers (N) as the inside of a character class."""
    added = [tuple(int(x, 16) for x in (r + "-" + r).split("-")[:2]) for r in (NEW_LETTERS if kind == "L" else NEW_NUMBERS).split()]
    inside = np.zeros(0x110000 + 1, bool)
    inside[:-1] = [unicodedata.category(chr(c))[0] == kind for c in range(0x110000)]
    for first, last in added:
        inside[first : last + 1] = True
    edges = np.flatnonzero(np.diff(np.append(False, inside).astype(np.int8)))
    return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it shows, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder read from a tokenizers JSON file of a byte-level BPE with word ends.

    It supports what such files use: normalisers NFC, replacement of a pattern
    and lower case; a split by pattern that keeps the matches; special tokens
    found in the raw text. Anything else raises.
    """

    _made: dict[str, "PairIndexBpe"] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as source:
            spec = json.load(source)
        model = spec["model"]
        if model["type"] != "BPE" or spec["decoder"] or model["byte_fallback"] or model["ignore_merges"] or model["dropout"]:
            raise ValueError("unsupported tokenizer model")
        self.suffix = model["end_of_word_suffix"] or ""
        vocab: dict[str, int] = model["vocab"]
        self.size = max(*vocab.values(), *(t["id"] for t in spec["added_tokens"])) + 1
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("unsupported special token")
        self._specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.steps = []
        for step in spec["normalizer"]["normalizers"]:
            if step["type"] == "Replace":
                self.steps.append((regex.compile(step["pattern"]["Regex"]), step["content"]))
            elif step["type"] in ("NFC", "Lowercase"):
                self.steps.append((step["type"], None))
            else:
                raise ValueError(f"unsupported normaliser {step['type']}")
        split, level = spec["pre_tokenizer"]["pretokenizers"]
        if split["behavior"] != "Removed" or not split["invert"] or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("unsupported split")
        # The classes are spelled out, as libraries differ in the Unicode version they know.
        spelled = split["pattern"]["Regex"]
        for kind in "LN":
            inside = character_class(kind)
            spelled = re.sub(rf"\[\\p\{{{kind}\}}\]|\\p\{{{kind}\}}", lambda m: f"[{inside}]" if m.group()[0] == "[" else inside, spelled)
        self.pieces = regex.compile(spelled)

        shown = byte_alphabet()
        self.byte = np.array([vocab[c] for c in shown], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in shown], np.int64)
        self.token = [""] * self.size
        for text, i in [*vocab.items(), *self.special.items()]:
            self.token[i] = text
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        keys = self.left * self.size + self.right
        self._by_key = np.argsort(keys, kind="stable")
        self._keys = keys[self._by_key]
        # Ranks whose result takes part in a merge of a lower rank: there a word
        # may not have all its places merged at once.
        lowest = np.full(self.size, len(merges), np.int64)
        ranks = np.arange(len(merges))
        np.minimum.at(lowest, self.left, ranks)
        np.minimum.at(lowest, self.right, ranks)
        self.stepwise = lowest[self.made] < ranks
        self.known: dict[str, tuple[int, str, str]] = {}

    @classmethod
    def at(cls, path: str) -> "PairIndexBpe":
        """The encoder of this process for a file."""
        begin("bpe")
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def words(self, text: str) -> list[str | int]:
        """Normalised pieces of a text in order; a special token is its id."""
        found: list[str | int] = []
        for i, part in enumerate(self._specials.split(text)):
            if i % 2:
                found.append(self.special[part])
                continue
            for step, content in self.steps:
                if step == "NFC":
                    part = unicodedata.normalize("NFC", part)
                elif step == "Lowercase":  # each letter by itself, so a sigma at a word's end is like any other
                    part = part.replace("Σ", "σ").lower().translate(NEW_LOWER)
                else:
                    part = step.sub(content, part)
            found += self.pieces.findall(part)
        return found

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        key = left * self.size + right
        at = np.searchsorted(self._keys, key)
        at[at == len(self._keys)] = 0
        return np.where(self._keys[at] == key, self._by_key[at], -1)

    def merge(self, words: list[str]) -> list[np.ndarray]:
        """Ids of each word, all words at once."""
        if not words:
            return []
        raw = [w.encode() for w in words]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbol = self.byte[data]
        full = lengths > 0
        symbol[ends[full] - 1] = self.last[data[ends[full] - 1]]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[ends[full] - 1] = -1
        before[(ends - lengths)[full]] = -1
        word = np.repeat(np.arange(len(raw)), lengths)
        alive = np.ones(n, bool)

        index: dict[int, list[np.ndarray]] = defaultdict(list)
        active: list[int] = []

        def enter(places: np.ndarray) -> None:
            """Index the pairs that begin at these places."""
            ranks = self._rank(symbol[places], symbol[after[places]])
            there = ranks >= 0
            ranks, places = ranks[there], places[there]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, group in zip(ranks[np.append(0, cuts)].tolist(), np.split(places, cuts)):
                if rank not in index:
                    heapq.heappush(active, rank)
                index[rank].append(group)

        enter(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            groups = index.pop(rank)
            places = np.unique(np.concatenate(groups))
            left, right = self.left[rank], self.right[rank]
            places = places[alive[places] & (symbol[places] == left) & (after[places] >= 0)]
            places = places[symbol[after[places]] == right]
            if not len(places):
                continue
            if self.stepwise[rank]:  # the first place of each word now, the others in their turn
                first = np.append(True, word[places][1:] != word[places][:-1])
                if not first.all():
                    index[rank].append(places[~first])
                    heapq.heappush(active, rank)
                places = places[first]
            elif left == right:  # of overlapping places the leftmost counts
                taken, free = [], -1
                for place in places.tolist():
                    if place != free:
                        taken.append(place)
                        free = after[place]
                    else:
                        free = -1
                places = np.array(taken)
            gone = after[places]
            symbol[places] = self.made[rank]
            alive[gone] = False
            rest = after[gone]
            after[places] = rest
            follows = rest >= 0
            before[rest[follows]] = places[follows]
            ahead = before[places]
            enter(np.concatenate([ahead[ahead >= 0], places[follows]]))
        ids = symbol[alive]
        return np.split(ids, np.cumsum(np.bincount(word[alive], minlength=len(raw)))[:-1])

    def learn(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """For each distinct chunk: number of ids, the ids as text, and their tokens as text."""
        if len(self.known) > _MEMORY:
            self.known.clear()
        cut = {c: self.words(c) for c in chunks if c not in self.known}
        fresh = sorted({w for found in cut.values() for w in found if isinstance(w, str)})
        ids = dict(zip(fresh, (x.tolist() for x in self.merge(fresh))))
        for chunk, found in cut.items():
            own = [i for w in found for i in (ids[w] if isinstance(w, str) else (w,))]
            self.known[chunk] = (len(own), " ".join(map(str, own)), self.decode(own))
        return [self.known[c] for c in chunks]

    def encode(self, text: str) -> list[int]:
        """Ids of one text."""
        found = self.words(text)
        fresh = sorted({w for w in found if isinstance(w, str)})
        ids = dict(zip(fresh, (x.tolist() for x in self.merge(fresh))))
        return [i for w in found for i in (ids[w] if isinstance(w, str) else (w,))]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, special ones included, as a tokenizer without a decoder does."""
        return " ".join([self.token[i] for i in ids])

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """Number of ids, ids as text, and decoded text of each text."""
        whole = pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        chunks = pc.ascii_split_whitespace(whole)
        coded = chunks.flatten().dictionary_encode()
        names = coded.dictionary.to_pylist()
        learned = self.learn(names)
        if any(not x[0] and c for x, c in zip(learned, names)):  # chunks without a token leave no gap
            keep = pc.greater(pa.array([x[0] for x in learned], pa.int64()).take(coded.indices), 0)
            lists = pc.list_parent_indices(chunks).filter(keep)
            sizes = np.bincount(lists.to_numpy(), minlength=len(chunks))
            offsets, at = pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), coded.indices.filter(keep)
        else:
            offsets, at = pc.subtract(chunks.offsets, chunks.offsets[0]), coded.indices
        counts = np.array([x[0] for x in learned], np.int64)[at.to_numpy(zero_copy_only=False)]
        bounds = np.append(0, np.cumsum(counts))[offsets.to_numpy()]
        joined = [
            pc.binary_join(pa.ListArray.from_arrays(offsets, pa.array([x[k] for x in learned], pa.string()).take(at)), " ")
            for k in (1, 2)
        ]
        return np.diff(bounds), joined[0], joined[1]


remember("bpe", PairIndexBpe._made.clear)


def encode_decode(docs: DataFrame, tokenizer: str | None = None, id_column: str = "doc_id", text_column: str = "text", digests: bool = False) -> DataFrame:
    """Ids and decoded text of each whole text, one row per row, no shuffle.

    Returns ``doc_id``, ``n_tokens``, ``ids`` (decimal, joined by a space) and
    ``decoded``; with ``digests`` the lowercase hex SHA-256 of these two instead
    (``ids_sha256``, ``decoded_sha256``). A null text is empty: no ids, an empty
    decoded text. Repeated rows and null ids stay as they are.
    """
    text = F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text")
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = PairIndexBpe.at(tokenizer or default_tokenizer())
        for block in blocks(batches):
            counts, ids, decoded = bpe.encode_block(block.column("text"))
            if digests:
                ids, decoded = (pa.array([hashlib.sha256(t).hexdigest() for t in x.cast(pa.binary()).to_pylist()]) for x in (ids, decoded))
            yield pa.RecordBatch.from_arrays([block.column("doc_id"), pa.array(counts, pa.int64()), ids, decoded], names=["doc_id", "n_tokens", *names])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), text).mapInArrow(run, f"doc_id long, n_tokens long, {names[0]} string, {names[1]} string")
