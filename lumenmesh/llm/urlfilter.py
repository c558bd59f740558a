"""URL filter over a sorted digest array.

The list is one file: sorted 64-bit xxhash keys, then the full strings in the same order. Executors fetch the file
(Spark ships it to each of them, and again to any replacement), memory-map the keys, probe a whole batch with one
binary search and confirm every hit against the stored string, so that equal digests of different strings don't count.

A rule is ``host/path``: it fits its host and all subdomains if the url's path starts with the rule's; the longest
fitting rule wins (of equally long ones that with the longer host). Defined cases: null urls and urls without ``://``
have an empty host and path and fit no rule; a url that fits no rule gets the list's default verdict; repeated rules
count once, where the verdicts differ ``block`` wins; an empty list or table is fine; a null page_id, repeated rows and very
long urls are judged like any other row; columns other than page_id and url are ignored.
"""

from __future__ import annotations

import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, put, table

#: (rule, verdict), as the contract states them.
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]
#: Verdict of a url that is on no list.
DEFAULT = "allow"
#: Largest list, in bytes, that is shipped to every executor.
MOST_BYTES = 1 << 30


def pack(rules: list[tuple[str, str]]) -> bytes:
    """The digest array: counts, keys, verdicts, string offsets, then the strings."""
    best: dict[str, str] = {}
    for rule, verdict in rules:
        if "/" not in rule or verdict not in ("allow", "block"):
            raise ValueError(f"not a rule: {rule!r} {verdict!r}")
        best[rule] = "block" if "block" in (verdict, best.get(rule)) else "allow"
    rows = sorted((xxhash.xxh64_intdigest(r.encode()), r.encode(), v) for r, v in best.items())
    ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype("<u8")
    paths = sorted({len(r[1]) - r[1].index(b"/") for r in rows})
    labels = max([0, *(r[1].split(b"/")[0].count(b".") + 1 for r in rows)])
    head = np.array([len(rows), labels, len(paths), *paths], "<u8")
    keys = np.array([r[0] for r in rows], "<u8")
    block = np.array([r[2] == "block" for r in rows], "<u8")
    return b"".join([head.tobytes(), keys.tobytes(), block.tobytes(), ends.tobytes(), *(r[1] for r in rows)])


class DigestArray:
    """A memory-mapped list."""

    def __init__(self, path: str) -> None:
        raw = np.memmap(path, np.uint8, "r")
        n, self.labels, k = (int(x) for x in raw[:24].view("<u8"))
        at = 24 + 8 * k
        self.paths = [int(x) for x in raw[24:at].view("<u8")]
        self.keys = raw[at : at + 8 * n].view("<u8")
        self.block = raw[at + 8 * n : at + 16 * n].view("<u8")
        self.ends = raw[at + 16 * n : at + 24 * n + 8].view("<u8")
        self.text = raw[at + 24 * n + 8 :]

    def rule(self, i: int) -> bytes:
        return self.text[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Place of each string in the list, or -1."""
        out = np.full(len(probes), -1)
        if not len(self.keys) or not probes:
            return out
        want = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, want)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == want)):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == want[i]:  # digests may collide
                if self.rule(j) == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def probes(self, host: str, path: str) -> list[bytes]:
        """What the list may hold for a url: the host's last labels, each with every listed length of path."""
        if not path:
            return []
        host_b, path_b = host.encode(), path.encode()
        tails, end = [host_b], len(host_b)
        cuts = []
        for _ in range(self.labels):
            end = host_b.rfind(b".", 0, end)
            if end < 0:
                break
            cuts.append(host_b[end + 1 :])
        if end >= 0:  # the whole host has more labels than any rule
            tails = []
        return [t + path_b[:n] for t in tails + cuts for n in self.paths if n <= len(path_b)]


@lru_cache(maxsize=4)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def ship(spark: SparkSession, rules: list[tuple[str, str]]) -> str:
    """Writes the list to the shared folder and has Spark send it to the executors; returns its name."""
    data = pack(rules)
    if len(data) > MOST_BYTES:
        raise ValueError(f"the list takes {len(data)} bytes; at most {MOST_BYTES} are sent to every executor")
    name = f"url-digests-{uuid.uuid4().hex}.bin"
    spark.sparkContext.addFile(put(spark, name, data))
    return name


def host_of(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[tuple[str, str]], default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule, verdict; one row per row of pages."""
    name = ship(pages.sparkSession, rules)

    def run(batches):
        listed = _opened(name)
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            asked, owner = [], []
            for i, (h, p) in enumerate(zip(hosts, paths)):
                for probe in listed.probes(h, p):
                    asked.append(probe)
                    owner.append(i)
            best: dict[int, tuple] = {}
            for i, probe, j in zip(owner, asked, listed.find(asked)):
                if j >= 0:
                    text = probe.decode()
                    best[i] = max(best.get(i, (-1,)), (len(text), text.index("/"), text, "block" if listed.block[j] else "allow"))
            none = (0, 0, None, default)
            yield pa.RecordBatch.from_pydict({
                "page_id": batch.column("page_id"), "host": batch.column("host"), "path": batch.column("path"),
                "rule": pa.array([best.get(i, none)[2] for i in range(len(hosts))], pa.string()),
                "verdict": pa.array([best.get(i, none)[3] for i in range(len(hosts))], pa.string()),
            })

    key = pages.schema["page_id"].dataType.simpleString()
    rows = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return rows.mapInArrow(run, f"page_id {key}, host string, path string, rule string, verdict string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), RULES)


ORACLE_SQL = """
WITH u AS (
  SELECT page_id,
    CASE WHEN position('://' IN coalesce(url, '')) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest
  FROM pages
), s AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
), r(rule, rhost, rpath, verdict) AS (
  VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
    ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'),
    ('net/fr/', 'net', '/fr/', 'block')
), m AS (
  SELECT s.page_id, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM s JOIN r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
  GROUP BY s.page_id
)
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, 'allow') AS verdict
FROM s LEFT JOIN m USING (page_id)
"""
