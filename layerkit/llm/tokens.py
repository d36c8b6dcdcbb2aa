"""Whole texts to token ids by a public tokenizer, word by word with a memory of words.

A tokenizer that drops white space and never looks across it gives a text the
ids of its white-space separated chunks, one after the other. Words repeat, so
each distinct chunk is encoded once per task and the texts are put together by
array lookups.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from layerkit.llm.common import begin, remember

# Letters, then ASCII signs other than the apostrophe: two pieces for the tokenizer.
_WORD_AND_SIGNS = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)")
# Chunks held in memory; beyond it the memory starts afresh.
_MEMORY = 500_000
_JOINED = 20_000


def default_tokenizer() -> str:
    """Path of the word BPE that the queries use, as found on the machine that runs a task."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Encodes texts by a tokenizers file whose pieces end at white space (``</w>``).

    Truncation, padding and added special tokens are off. Special tokens in a
    text count as the tokenizer counts them.
    """

    _made: dict[str, "ChunkEncoder"] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.known: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> "ChunkEncoder":
        """The encoder of this process for a file, kept from task to task."""
        begin("tokens")
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def _words(self, words: list[str]) -> None:
        """Learn words of letters only: many in one text, told apart by the tokens that end a word."""
        for at in range(0, len(words), _JOINED):
            part = words[at : at + _JOINED]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(part) and stops[-1] == len(ids):
                data, stops = ids.tobytes(), (stops * 4).tolist()
                self.known.update(zip(part, (data[a:b] for a, b in zip([0, *stops], stops))))
            else:  # a letter that the tokenizer takes apart
                self.known.update(zip(part, self._whole(part)))

    def learn(self, chunks: list[str]) -> list[bytes]:
        """Ids of each distinct chunk, as little-endian unsigned 32-bit integers."""
        if len(self.known) > _MEMORY:
            self.known.clear()
        known = self.known
        new = [c for c in chunks if c not in known]
        if new:
            parts = {c: m.groups() for c in new if not c.isalpha() and (m := _WORD_AND_SIGNS.fullmatch(c))}
            words = {c for c in new if c.isalpha()} | {w for w, _ in parts.values() if w not in known}
            self._words(list(words))
            signs = {s for _, s in parts.values() if s not in known}
            rest = list(signs.union(c for c in new if c and c not in parts and c not in words))
            known.update(zip(rest, self._whole(rest)))
            known.update((c, known[w] + known[s]) for c, (w, s) in parts.items())
            known[""] = b""
        return [known[c] for c in chunks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text after the other, and the number of ids of each; a null text has none."""
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        coded = chunks.flatten().dictionary_encode()
        learned = pa.array(self.learn(coded.dictionary.to_pylist()), pa.large_binary())
        whole = learned.take(coded.indices)
        stops = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1, 8 * whole.offset) // 4
        flat = np.frombuffer(whole.buffers()[2] or b"", "<u4")[stops[0] : stops[-1]]
        edges = chunks.offsets.to_numpy()
        return flat, np.diff(stops[edges - edges[0]] - stops[0])


remember("tokens", ChunkEncoder._made.clear)
