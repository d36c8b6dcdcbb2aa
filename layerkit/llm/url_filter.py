"""Operator 10: URL rules in a sorted array of 64-bit digests.

The rules lie in one file: their xxhash digests in ascending order, then the
strings. Executors fetch it from the shared folder and map it into memory. The
candidate keys of a batch of URLs are probed by one binary search over the
array, and every hit is confirmed against the stored string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from layerkit.session import scratch_path

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
# Rules that one file may hold; the driver writes it, and executors map it.
MOST_RULES = 50_000_000


def digest_file(rules: list[tuple[str, str]]) -> bytes:
    """Rules (string, verdict) as bytes: count, digests, verdicts, string offsets, strings.

    A repeated rule counts once; with two verdicts it raises.
    """
    own = dict(rules)
    if len(own) != len(set(rules)):
        raise ValueError("a rule has two verdicts")
    if len(own) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    names = [name.encode() for name in own]
    digests = np.array([xxhash.xxh64_intdigest(n) for n in names], "<u8")
    order = np.argsort(digests, kind="stable")
    sizes = np.array([len(names[i]) for i in order], np.int64)
    blocked = np.array([own[names[i].decode()] == BLOCK for i in order], np.uint8)
    return b"".join((
        np.array([len(names)], "<u8").tobytes(), digests[order].tobytes(), blocked.tobytes(),
        np.append(0, np.cumsum(sizes)).astype("<u8").tobytes(), b"".join(names[i] for i in order),
    ))


class DigestArray:
    """A rule file mapped into memory."""

    _open: dict[str, "DigestArray"] = {}

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = int(raw[:8].view("<u8")[0])
        self.digests = raw[8 : 8 + 8 * n].view("<u8")
        self.blocked = raw[8 + 8 * n : 8 + 9 * n]
        self.offsets = np.frombuffer(raw, "<u8", n + 1, 8 + 9 * n)
        self.strings = raw[8 + 9 * n + 8 * (n + 1) :]
        # Shapes that a key can have: labels of the host, bytes of the path.
        self.shapes = sorted({self._shape(self.text(i)) for i in range(n)})

    @classmethod
    def at(cls, path: str) -> "DigestArray":
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    @staticmethod
    def _shape(rule: bytes) -> tuple[int, int]:
        host, _, path = rule.partition(b"/")
        return host.count(b".") + 1, len(path) + 1

    def text(self, i: int) -> bytes:
        return self.strings[int(self.offsets[i]) : int(self.offsets[i + 1])].tobytes()

    def probe(self, keys: list[bytes]) -> np.ndarray:
        """Place of each key in the array, -1 where it is not; equal digests of other strings are passed over."""
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        out = np.full(len(keys), -1, np.int64)
        inside = np.flatnonzero(at < len(self.digests))
        for i in inside[self.digests[at[inside]] == wanted[inside]].tolist():
            place = int(at[i])
            while place < len(self.digests) and self.digests[place] == wanted[i]:
                if self.text(place) == keys[i]:
                    out[i] = place
                    break
                place += 1
        return out

    def candidates(self, host: bytes, path: bytes) -> list[bytes]:
        """Keys under which a rule for this URL may lie."""
        labels = host.split(b".")
        found = []
        for n, size in self.shapes:
            if n <= len(labels) and size <= len(path):
                found.append(b".".join(labels[-n:]) + path[:size])
        return found

    def judge(self, hosts: list[bytes], paths: list[bytes]) -> list[int]:
        """Place of the longest rule that fits each URL (of two as long, the one with the longer host), -1 for none."""
        keys, owners = [], []
        for row, (host, path) in enumerate(zip(hosts, paths)):
            found = self.candidates(host, path)
            keys += found
            owners += [row] * len(found)
        best = [-1] * len(hosts)
        places = self.probe(keys)
        for i in np.flatnonzero(places >= 0).tolist():
            row, place = owners[i], int(places[i])
            if best[row] < 0 or self._weight(place) > self._weight(best[row]):
                best[row] = place
        return best

    def _weight(self, place: int) -> tuple[int, int]:
        text = self.text(place)
        return len(text), text.index(b"/")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    at = F.instr(url, "://")
    after = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def share_rules(spark: SparkSession, rules: list[tuple[str, str]]) -> str:
    """Write the rule file to the shared folder and have executors fetch it; returns its name there."""
    path = scratch_path(spark, "url-rules")
    store, place = fs.FileSystem.from_uri(path)
    store.create_dir(place.rpartition("/")[0], recursive=True)
    with store.open_output_stream(place) as out:
        out.write(digest_file(rules))
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], default: str = ALLOW, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row; no shuffle.

    A rule is host and path, like ``example.com/en/``. It fits its host and all
    subdomains where the path starts with its own; the longest rule decides. A URL
    that is not in the array (no rule fits, or it has no host) gets ``default``.
    Repeated rows and null ids stay.
    """
    for rule, verdict in rules:
        if "/" not in rule or not rule.partition("/")[0] or verdict not in (ALLOW, BLOCK):
            raise ValueError(f"not a rule: {rule!r}, {verdict!r}")
    name = share_rules(pages.sparkSession, rules)
    host, path = host_and_path(F.col(url_column).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.at(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = (batch.column(c).cast(pa.binary()).to_pylist() for c in ("host", "path"))
            found = array.judge(hosts, paths)
            rule = [array.text(p).decode() if p >= 0 else None for p in found]
            verdict = [default if p < 0 else BLOCK if array.blocked[p] else ALLOW for p in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=[*batch.schema.names, "rule", "verdict"],
            )

    urls = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    return urls.mapInArrow(run, f"page_id {dict(urls.dtypes)['page_id']}, host string, path string, rule string, verdict string")
