"""URL allow and block lists as a sorted array of 64-bit digests in a memory-mapped file.

The file holds, one after the other: a header, the sorted xxhash64 keys, the offsets of the
full entries, and the entries themselves (key, a tab, the verdict). A url's candidate keys
(each suffix of its host with each prefix of its path that is as long as some listed path)
are hashed, probed by one vectorised binary search, and every hit is confirmed against the
stored string, so a collision of digests cannot decide a url.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame

from .runtime import ship

MAGIC = b"URLDIG01"
#: Entries that one file may hold: 8 bytes of key and 8 of offset each, beside the strings. Larger lists are refused.
MOST_ENTRIES = 50_000_000


def write_digests(rules: Iterable[tuple[str, str, str]], path: str) -> int:
    """Write (verdict, host, path) rules; the key of a rule is host + path. The first verdict of a key holds.

    Returns the number of entries. Hosts are lower-cased (A-Z), paths begin with "/" (empty means "/")."""
    seen: dict[str, str] = {}
    for verdict, host, where in rules:
        seen.setdefault(_lower(host) + (where or "/"), verdict)
    if len(seen) > MOST_ENTRIES:
        raise ValueError(f"{len(seen)} entries; one file holds {MOST_ENTRIES}")
    entries = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in seen.items())
    blobs = [f"{k}\t{v}".encode() for _, k, v in entries]
    lengths = sorted({len(k) - k.index("/") for _, k, _ in entries})
    with open(path, "wb") as f:
        f.write(MAGIC + np.array([len(entries), len(lengths)], "<i8").tobytes())
        f.write(np.array(lengths, "<i8").tobytes())
        f.write(np.array([d for d, _, _ in entries], "<u8").tobytes())
        f.write(np.cumsum([0, *map(len, blobs)]).astype("<i8").tobytes())
        f.write(b"".join(blobs))
    return len(entries)


class DigestFile:
    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        if raw[:8].tobytes() != MAGIC:
            raise ValueError("not a digest file")
        n, m = raw[8:24].view("<i8")
        at = 24
        self.lengths = raw[at : (at := at + 8 * int(m))].view("<i8").tolist()  # of listed paths
        self.keys = raw[at : (at := at + 8 * int(n))].view("<u8")
        self.ends = raw[at : (at := at + 8 * (int(n) + 1))].view("<i8")
        self.blob = raw[at:]

    def find(self, keys: list[str]) -> list[str | None]:
        """The verdict of each key, None where it is not listed."""
        out: list[str | None] = [None] * len(keys)
        if not len(self.keys) or not keys:
            return out
        digests = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), "<u8", len(keys))
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        for i in hit.tolist():
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:  # entries that share a digest lie together
                key, _, verdict = self.blob[self.ends[j] : self.ends[j + 1]].tobytes().decode().rpartition("\t")
                if key == keys[i]:
                    out[i] = verdict
                    break
                j += 1
        return out


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _lower(s: str) -> str:
    return s.translate(_LOWER)


def _end(s: str, stops: str) -> str:
    for c in stops:
        s = s.partition(c)[0]
    return s


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) as the operator reads them; both empty for null or without ://."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    host = _end(rest, "/?#")
    return _lower(host), _end(rest[len(host) :], "?#")


def candidates(host: str, path: str, lengths: list[int]) -> list[str]:
    """Keys that would fit, longest first within a host suffix."""
    labels = host.split(".")
    return [".".join(labels[k:]) + path[:n] for k in range(len(labels)) for n in reversed(lengths) if n <= len(path)] if host else []


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", unlisted: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. The rule with the longest key
    (host + path) wins. Where none fits, rule is null and the verdict is ``unlisted``: the url is not in the array.
    A url that is null, empty or without :// has empty host and path and fits nothing. Ids may be null or repeat; other columns are not read.
    The rules travel as one file to each executor, which maps it; its size is bounded by MOST_ENTRIES.
    """
    spark = pages.sparkSession
    ship(spark)
    rules = list(rules)
    name = f"urls-{hashlib.md5(repr(rules).encode()).hexdigest()}-{spark.sparkContext.applicationId}.dig"
    if not any(f.endswith(f"/{name}") for f in spark.sparkContext.listFiles):
        # a folder of its own: no other process writes or shortens a file that is being read
        path = os.path.join(tempfile.mkdtemp(prefix="urls"), name)
        write_digests(rules, path)
        spark.sparkContext.addFile(path)

    def run(batches):
        file = DigestFile(SparkFiles.get(name))
        for b in batches:
            split = [split_url(u) for u in b.column(1).to_pylist()]
            keys = [candidates(*s, file.lengths) for s in split]
            flat = sorted({k for ks in keys for k in ks})
            known = {k: v for k, v in zip(flat, file.find(flat), strict=True) if v is not None}
            best = [max((k for k in ks if k in known), key=len, default=None) for ks in keys]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array(best, pa.string()), pa.array([unlisted if k is None else known[k] for k in best], pa.string())],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
