"""URL filter: a sorted array of 64-bit xxhash digests, probed by binary search.

The rule list becomes one index: the digests in sorted order, beside them the
offsets of the full rule strings and their verdicts.  A task writes the index
once to an unlinked temporary file and maps it, so it costs no heap and its
pages are shared; a batch of urls is probed with ``numpy.searchsorted``.  A
digest that fits is only taken when the stored string equals the probed one, so
a collision never decides.

A url's probes are the (host suffix, path prefix) pairs it could fit; only
host suffixes and path prefixes of lengths that occur among the rules are tried, so a
host of many dots costs no more than another.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import packed, unpacked

#: Largest rule list, in bytes of strings, that is sent to every executor.
MAX_INDEX_BYTES = 256 << 20


def build_index(rules: Iterable[tuple[str, str, str]]) -> dict:
    """(host, path, verdict) rules -> index.  Rules given twice count once; of
    two verdicts for one rule, block holds."""
    best: dict[bytes, bool] = {}
    for host, path, verdict in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"verdict {verdict!r}")
        k = f"{host}{path}".encode()
        best[k] = best.get(k, False) or verdict == "block"
    size = sum(map(len, best))
    if size > MAX_INDEX_BYTES:
        raise ValueError(f"{size} bytes of rules: split the list by host and run the filter on each part")
    digests = np.array([xxhash.xxh64_intdigest(k) for k in best], np.uint64)
    order = np.argsort(digests, kind="stable")
    names = list(best)
    keys = [names[i] for i in order]
    offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int64)
    return {"n": len(keys), "digests": digests[order].tobytes(), "offsets": offsets.tobytes(),
            "block": bytes(best[k] for k in keys), "strings": b"".join(keys),
            "hosts": sorted({k.find(b"/") if b"/" in k else len(k) for k in keys}),
            "paths": sorted({len(k) - k.find(b"/") if b"/" in k else 0 for k in keys}, reverse=True)}


class Probe:
    """The mapped index of one task."""

    def __init__(self, index: dict):
        self.n, self.hosts, self.paths = index["n"], index["hosts"], index["paths"]
        parts = [index["digests"], index["offsets"], index["block"], index["strings"]]
        with tempfile.TemporaryFile() as f:  # unlinked: gone with the mapping
            f.write(b"".join(parts) or b"\0")
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        at = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        self.digests = np.frombuffer(self.map, np.uint64, self.n, at[0])
        self.offsets = np.frombuffer(self.map, np.int64, self.n + 1, at[1])
        self.block = np.frombuffer(self.map, np.uint8, self.n, at[2])
        self.strings = int(at[3])

    def find(self, keys: list[bytes]) -> np.ndarray:
        """Index of each key's rule, -1 for none."""
        out = np.full(len(keys), -1, np.int64)
        if not keys or not self.n:
            return out
        d = np.fromiter((xxhash.xxh64_intdigest(k) for k in keys), np.uint64, len(keys))
        lo = np.searchsorted(self.digests, d, "left")
        hi = np.searchsorted(self.digests, d, "right")
        for i in np.flatnonzero(lo < hi):  # digests that fit: compare the strings
            for j in range(lo[i], hi[i]):
                if self.text(j) == keys[i]:
                    out[i] = j
                    break
        return out

    def text(self, j: int) -> bytes:
        return self.map[self.strings + int(self.offsets[j]):self.strings + int(self.offsets[j + 1])]


def host_and_path(url: str) -> tuple[str, str]:
    _, sep, rest = url.partition("://")
    if not sep:
        return "", ""
    rest = rest[:min((i for i in (rest.find("?"), rest.find("#")) if i >= 0), default=len(rest))]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def _keys(host: str, path: str, hosts: list[int], lengths: list[int]) -> list[bytes]:
    """Every rule string this url could fit, longest first."""
    h, p = host.encode(), path.encode()
    ends = [h[len(h) - n:] for n in hosts if 0 < n <= len(h) and (n == len(h) or h[-n - 1:len(h) - n] == b".")]
    found = [e + p[:n] for e in ends for n in lengths if n <= len(p)]
    return sorted(set(found), key=len, reverse=True)


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url: str = "url",
               default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and every subdomain of it where the url's path starts
    with the rule's; the longest fitting rule wins, without one ``default``
    holds.  Null urls and urls without ``://`` have an empty host and path.
    Columns of ``pages`` with the names of results give way to the results.
    """
    index = pages.sparkSession.sparkContext.broadcast(build_index(rules))  # size checked there
    new = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in new]
    src = pages.select(packed(pages, kept), F.col(f"`{url}`").cast("string").alias("_url"))

    def judge(batches):
        probe = Probe(index.value)
        for b in batches:
            parts = [host_and_path(u or "") for u in b.column(b.num_columns - 1).to_pylist()]
            keys = [_keys(h, p, probe.hosts, probe.paths) for h, p in parts]
            hit = probe.find([k for ks in keys for k in ks])
            rule, verdict, at = [], [], 0
            for ks in keys:
                j = next((int(x) for x in hit[at:at + len(ks)] if x >= 0), -1)
                at += len(ks)
                rule.append(probe.text(j).decode() if j >= 0 else None)
                verdict.append(default if j < 0 else "block" if probe.block[j] else "allow")
            cols = [*b.columns[:-1], pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["_in", *new])

    schema = src.drop("_url").schema
    for c in new:
        schema = schema.add(c, "string")
    return src.mapInArrow(judge, schema).select(*unpacked(kept), *new)


URL_SQL = r"""
WITH u AS (SELECT page_id, url, strpos(url, '://') AS pos FROM pages),
r AS (SELECT page_id, CASE WHEN pos > 0 THEN regexp_extract(substr(url, pos + 3), '^[^?#]*') ELSE '' END AS rest FROM u),
h AS (SELECT page_id, regexp_extract(rest, '^[^/]*') AS raw,
             substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM r),
t AS (SELECT page_id, coalesce(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(path, '') AS path FROM h),
v AS (SELECT page_id, host, path,
        CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
             WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
             WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
             WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
        END AS rule FROM t)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM v
"""
