"""URL filter: rules in sorted digest arrays, probed by binary search, hits confirmed by their strings.

A rule is a host and the start of a path, with a verdict. Spark sorts the rules by the
64-bit xxhash of host and path and writes them as flat files: digests, ends of the
entries and the entries themselves. Executors fetch the files once; their Python
workers map them into memory, so that a list of any size takes shared pages of the
machine and no heap. A second array of the same form holds the rules' hosts with the
lengths of their paths, so a URL is probed with the suffixes of its host first and then
only with path starts that some rule of that host has.

Pages are not shuffled: a frequent host costs what its rows cost.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.llm.common import pick, worker_state
from newsprism.session import checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"
PARTS = ("keys", "ends", "sizes", "entries")
DDL = "keys binary, ends binary, sizes binary, entries binary"
Digest = Callable[[bytes], int]


def xxh64(key: bytes) -> int:
    return xxhash.xxh64_intdigest(key)


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class SortedDigests:
    """Key -> value by binary search in sorted 64-bit digests; the stored key decides, not the digest."""

    def __init__(self, keys, ends, sizes, entries, digest: Digest = xxh64):
        self.keys, self.ends, self.sizes, self.entries, self.digest = keys, ends, sizes, entries, digest

    @classmethod
    def mapped(cls, paths: dict[str, str], digest: Digest = xxh64) -> SortedDigests:
        kinds = {"keys": "<u8", "ends": "<i8", "sizes": "<i4", "entries": "u1"}
        return cls(*[np.memmap(paths[p], dtype=kinds[p], mode="r") if os.path.getsize(paths[p])
                     else np.empty(0, dtype=kinds[p]) for p in PARTS], digest)

    def find(self, wanted: list[bytes]) -> list[bytes | None]:
        """The value of each key, None where there is none."""
        out: list[bytes | None] = [None] * len(wanted)
        n = len(self.keys)
        if not n or not wanted:
            return out
        digests = np.fromiter(map(self.digest, wanted), dtype=np.uint64, count=len(wanted))
        at = np.searchsorted(self.keys, digests)
        asked = np.arange(len(wanted))
        while len(asked):
            near = at < n
            near[near] = self.keys[at[near]] == digests[asked[near]]
            asked, at = asked[near], at[near]
            again = np.zeros(len(asked), dtype=bool)
            for i, (which, place) in enumerate(zip(asked.tolist(), at.tolist())):
                begin, end, size = int(self.ends[place - 1]) if place else 0, int(self.ends[place]), int(self.sizes[place])
                if self.entries[begin:begin + size].tobytes() == wanted[which]:
                    out[which] = self.entries[begin + size:end].tobytes()
                else:  # another key of the same digest: the next entry may be the one
                    again[i] = True
            asked, at = asked[again], at[again] + 1
        return out


def write_sorted(entries: DataFrame, home: str, digest: Digest = xxh64) -> dict[str, str]:
    """Files of a sorted digest array over rows (key binary, value binary) with distinct keys.

    The rows are sorted and packed by Spark; the driver passes one packed batch after
    another on to the files in the shared folder ``home`` and keeps none.
    """
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # the digest's order as unsigned: signed order of the digest less 2^63
            digests = [digest(k) - (1 << 63) for k in b.column("key").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), b.column("key"), b.column("value")],
                                             ["digest", "key", "value"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, values = b.column("key").to_pylist(), b.column("value").to_pylist()
            digests = b.column("digest").to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            lengths = np.array([len(k) + len(v) for k, v in zip(keys, values)], dtype="<i8")
            row = [digests.astype("<u8").tobytes(), lengths.tobytes(),
                   np.array([len(k) for k in keys], dtype="<i4").tobytes(),
                   b"".join(x for pair in zip(keys, values) for x in pair)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], list(PARTS))

    spark = entries.sparkSession
    ordered = entries.mapInArrow(hashed, "digest long, key binary, value binary").orderBy("digest", "key")
    stem = f"{home.rstrip('/')}/{uuid.uuid4().hex}"
    paths = {p: f"{stem}.{p}" for p in PARTS}
    folder = spark._jvm.org.apache.hadoop.fs.Path(home)
    files = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    streams = {p: files.create(spark._jvm.org.apache.hadoop.fs.Path(path)) for p, path in paths.items()}
    end = 0
    try:
        for row in ordered.mapInArrow(packed, DDL).toLocalIterator():
            ends = np.cumsum(np.frombuffer(row["ends"], dtype="<i8")) + end
            end = int(ends[-1])
            for p in PARTS:
                streams[p].write(bytearray(ends.astype("<i8").tobytes() if p == "ends" else row[p]))
    finally:
        for stream in streams.values():
            stream.close()
    return paths


@dataclass(frozen=True)
class UrlIndex:
    """File names of the two arrays, as executors know them, and the greatest length of a rule's host."""
    rules: tuple[str, ...]
    hosts: tuple[str, ...]
    longest_host: int
    digest: Digest = xxh64

    def open(self) -> tuple[SortedDigests, SortedDigests]:
        return tuple(SortedDigests.mapped({p: SparkFiles.get(name) for p, name in zip(PARTS, names)}, self.digest)
                     for names in (self.rules, self.hosts))


def build_index(rules: DataFrame, digest: Digest = xxh64) -> UrlIndex:
    """Index of rules (host, path, verdict), handed to all executors.

    Hosts are lower-cased (A-Z). A host is not empty and holds no ``/``; a path is empty
    or starts with ``/``; a verdict is allow or block: else ValueError. Of equal rules
    with both verdicts, block stands.
    """
    spark = rules.sparkSession
    clean = rules.select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    good = ((F.length("host") > 0) & ~F.contains("host", F.lit("/")) & F.col("verdict").isin(ALLOW, BLOCK)
            & ((F.col("path") == "") | F.startswith("path", F.lit("/"))))
    bad = clean.where(~F.coalesce(good, F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"not a rule: {bad[0].asDict()}")
    single = clean.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    longest = single.agg(F.max(F.length("host"))).first()[0] or 0
    # value of a rule: its verdict; value of a host: the lengths of its rules' paths, comma-joined
    rule_rows = single.select(F.concat("host", "path").cast("binary").alias("key"), F.col("verdict").cast("binary").alias("value"))
    lengths = F.array_join(F.transform(F.sort_array(F.collect_set(F.length("path"))), lambda n: n.cast("string")), ",")
    host_rows = single.groupBy("host").agg(lengths.alias("l")).select(
        F.col("host").cast("binary").alias("key"), F.col("l").cast("binary").alias("value"))
    home = f"{checkpoint_dir(spark).rstrip('/')}/url_rules/{spark.sparkContext.applicationId}"
    names = []
    for rows in (rule_rows, host_rows):
        paths = write_sorted(rows, home, digest)
        for path in paths.values():
            spark.sparkContext.addFile(path)
        names.append(tuple(paths[p].rsplit("/", 1)[1] for p in PARTS))
    return UrlIndex(names[0], names[1], longest, digest)


def suffixes(host: str, longest: int) -> list[str]:
    """The host and what follows each of its dots, where no longer than ``longest``."""
    tail = max(0, len(host) - longest)
    found = [host] if not tail else []
    dot = host.find(".", max(0, tail - 1))
    while dot >= 0:
        found.append(host[dot + 1:])
        dot = host.find(".", dot + 1)
    return found


def decide(hosts: list[str], paths: list[str], index: UrlIndex, arrays: tuple[SortedDigests, SortedDigests],
           default: str) -> tuple[list[str | None], list[str]]:
    """(rule, verdict) of each URL: the longest rule that fits, of equal lengths that of the longer host."""
    rules, known = arrays
    of_host = {h: suffixes(h, index.longest_host) for h in set(hosts)}
    probes = list({s for found in of_host.values() for s in found})
    lengths = {s: [int(n) for n in v.split(b",")] for s, v in zip(probes, known.find([s.encode() for s in probes])) if v}
    of_host = {h: [s for s in found if s in lengths] for h, found in of_host.items()}
    urls = {u: [(s, u[1][:n]) for s in of_host[u[0]] for n in lengths[s] if n <= len(u[1])] for u in set(zip(hosts, paths))}
    starts = list({c for cs in urls.values() for c in cs})
    verdicts = {c: v.decode() for c, v in zip(starts, rules.find([(s + p).encode() for s, p in starts])) if v}
    judged = {}
    for url, found in urls.items():
        fits = [c for c in found if c in verdicts]
        best = max(fits, key=lambda c: (len(c[0]) + len(c[1]), len(c[0])), default=None)
        judged[url] = (None, default) if best is None else (best[0] + best[1], verdicts[best])
    out = [judged[u] for u in zip(hosts, paths)]
    return [r for r, _ in out], [v for _, v in out]


def judge_urls(df: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW,
               digest: Digest = xxh64) -> DataFrame:
    """One row per input row: page_id, host, path, rule (null if none fits), verdict.

    A rule fits its host and all subdomains where the URL's path starts with the rule's;
    the longest rule (host and path together) decides, without one ``default`` does.
    Null URLs and such without ``://`` have an empty host and path, which no rule fits.
    URLs of any length are probed whole. Repeated rows return a row each, a null id
    stays null, an empty table gives an empty result, an empty rule list ``default``.
    """
    index = build_index(rules, digest)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrays = worker_state(("url_filter", index), index.open)
        for b in batches:
            rule, verdict = decide(b.column("host").to_pylist(), b.column("path").to_pylist(), index, arrays, default)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             ["page_id", "host", "path", "rule", "verdict"])

    rows = pick(df, page_id=id_col, url=url_col)
    url = F.col("url").cast("string")
    return (rows.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
            .mapInArrow(judged, "page_id long, host string, path string, rule string, verdict string"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules (verdict, host, path) as a table."""
    return spark.createDataFrame(rules, "verdict string, host string, path string")
