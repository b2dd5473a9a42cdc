"""URL rules in a sorted array of digests.

The index is one file: the 64-bit xxhash digests of the rules in ascending order, the places of their
strings, the verdicts, the strings. Executors get the file by Spark's own file distribution, also those
that join later, and memory-map it, so all workers of a machine share its pages. A url is looked up by
what could be a rule for it, a suffix of its host at a label and a start of its path of a length that
some rule has; digests are found by binary search for a whole batch, and a hit counts only if
the stored string is the same. The longest rule that fits wins, between equal lengths the longer host.

Results for odd rows: a null url, or one without "://", has an empty host and path, fits no rule and gets
the default verdict; an empty one too; a very long url is judged whole; of rules of one length that fit the longer host wins, so there are no ties;
repeated rows each get their own result, null ids stay; no rows give no rows; columns besides the id and the url are
ignored, whatever their names. Repeated rules must agree; the strings may be of any length.
"""

from __future__ import annotations

import hashlib
import os
import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import workers_can_import

#: Fixed values of the query: block or allow, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
HEADER = struct.Struct("<4sQQQ")
MAGIC = b"URL1"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def build(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The index of (verdict, host, path) rules. It is made on the driver: some 50 bytes and the string a rule."""
    found: dict[bytes, int] = {}
    lengths: set[int] = set()
    for verdict, host, path in rules:
        if verdict not in ("block", "allow") or "/" in host or (path and path[0] != "/"):
            raise ValueError(f"not a rule: {verdict} {host}{path}")
        key = (host.translate(str.maketrans(UPPER, LOWER)) + path).encode()
        if found.setdefault(key, verdict == "allow") != (verdict == "allow"):
            raise ValueError(f"both block and allow: {key.decode()}")
        lengths.add(len(path))
    keys = sorted(found, key=xxhash.xxh64_intdigest)
    digests = np.array([xxhash.xxh64_intdigest(x) for x in keys], "<u8")
    ends = np.cumsum([0] + [len(x) for x in keys]).astype("<u8")
    verdicts = np.array([found[x] for x in keys], "<u8")
    return HEADER.pack(MAGIC, len(keys), len(lengths), int(ends[-1])) + digests.tobytes() + ends.tobytes() + verdicts.tobytes() + np.array(sorted(lengths), "<u8").tobytes() + b"".join(keys)


class Index:
    """A memory-mapped index."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        magic, n, n_lengths, _ = HEADER.unpack_from(raw[: HEADER.size].tobytes())
        if magic != MAGIC:
            raise ValueError(f"{path}: not an index of this format")
        at = HEADER.size
        self.digests, self.ends, self.verdicts, lengths = (raw[a : a + 8 * k].view("<u8") for a, k in ((at, n), (at + 8 * n, n + 1), (at + 16 * n + 8, n), (at + 24 * n + 8, n_lengths)))
        self.lengths = sorted(lengths.tolist(), reverse=True)
        self.strings = raw[at + 24 * n + 8 + 8 * n_lengths :]

    def _rule(self, at: int) -> bytes:
        return self.strings[int(self.ends[at]) : int(self.ends[at + 1])].tobytes()

    def places(self, keys: list[bytes]) -> np.ndarray:
        """The place of each key among the rules, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.digests) or not keys:
            return out
        wanted = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(keys))
        at = np.searchsorted(self.digests, wanted)
        for i in np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == wanted):
            j = int(at[i])
            while j < len(self.digests) and self.digests[j] == wanted[i]:  # rules with one digest stand together
                if self._rule(j) == keys[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> tuple[list[str | None], list[str | None]]:
        """The longest rule that fits each host and path, and its verdict."""
        distinct: dict[bytes, int] = {}
        which, url, rank = [], [], []
        for i, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            suffix = host
            while suffix:
                for n in self.lengths:
                    if n <= len(path):
                        which.append(distinct.setdefault((suffix + path[:n]).encode(), len(distinct)))
                        url.append(i)
                        rank.append(((len(suffix) + n) << 32) | len(suffix))
                suffix = suffix.partition(".")[2]
        found = self.places(list(distinct))[np.array(which, np.int64)] if which else np.zeros(0, np.int64)
        best: dict[int, tuple[int, int]] = {}
        for k in np.flatnonzero(found >= 0):
            best[url[k]] = max(best.get(url[k], (-1, -1)), (rank[k], int(found[k])))
        rules: list[str | None] = [None] * len(hosts)
        verdicts: list[str | None] = [None] * len(hosts)
        for i, (_, at) in best.items():
            rules[i], verdicts[i] = self._rule(at).decode(), "allow" if self.verdicts[at] else "block"
        return rules, verdicts


@lru_cache(maxsize=2)
def _opened(name: str) -> Index:
    return Index(SparkFiles.get(name))


def distribute(spark: SparkSession, index: bytes) -> str:
    """Gives the index to all executors; returns its name there."""
    name = f"url-rules-{hashlib.sha256(index).hexdigest()[:32]}"
    if name not in {os.path.basename(x) for x in spark.sparkContext.listFiles}:
        # the driver's own copy; executors fetch it from the driver
        path = os.path.join(SparkFiles.getRootDirectory(), "..", f".{name}")
        os.makedirs(path, exist_ok=True)
        with open(os.path.join(path, name), "wb") as f:
            f.write(index)
        spark.sparkContext.addFile(os.path.abspath(os.path.join(path, name)))
    return name


def with_host_and_path(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """host, path of each url, as DataFrame expressions."""
    rest = F.when(F.instr(url_col, "://") > 0, F.expr(f"substring(`{url_col}`, instr(`{url_col}`, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return pages.withColumns({"host": host, "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def judge(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = RULES, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id_col, host, path, rule, verdict of each row."""
    spark = pages.sparkSession
    workers_can_import(spark)
    name = distribute(spark, build(rules))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _opened(name)
        for batch in batches:
            found, verdicts = index.judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
            arrays = [*batch.columns, pa.array(found, pa.string()), pa.array([x or default for x in verdicts], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "host", "path", "rule", "verdict"])

    source = with_host_and_path(pages.select(id_col, url_col), url_col).select(id_col, "host", "path")
    text = [T.StructField(x, T.StringType()) for x in ("host", "path", "rule", "verdict")]
    return source.mapInArrow(run, T.StructType([source.schema[0], *text]))


SQL = """
WITH u AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
    SELECT page_id,
           translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
    FROM u
), r(verdict, rule_host, rule_path) AS (
    VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), best AS (
    SELECT page_id, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(verdict, length(rule_host || rule_path)) AS verdict
    FROM p JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
    GROUP BY page_id
)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""
