"""URL filters: glob rules packed into multiword Shift-And masks, all simulated at once over each canonical URL.

A canonical URL is ``.host/path``: the host (A-Z lower-cased) after a dot, so that ``*.example.org/`` fits the host and every
subdomain, then the path up to ``?`` or ``#``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

_URL = re.compile(r"://([^/?#]*)([^?#]*)", re.S)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Rule(NamedTuple):
    """``*`` stands for any run without a slash, ``**`` for any run, ``?`` for one byte but a slash."""

    name: str
    glob: str
    verdict: str


def host_rule(verdict: str, rule: str) -> Rule:
    """``host/path`` as a glob: the host and its subdomains, paths that start with the rule's."""
    return Rule(rule, f"*.{rule}**", verdict)


#: Fixed rules of the query; the longest that fits decides.
BASE_RULES = [
    host_rule("allow", "org/"),
    host_rule("block", "example.org/es/"),
    host_rule("block", "example.org/en/1"),
    host_rule("allow", "com/fr/"),
    host_rule("block", "com/de/"),
]
#: The method's own rules for urls that no base rule fits: spam hosts, adult and gambling zones, log-in pages, binaries.
DEFAULT_RULES = [
    Rule("spam", "*spam*/**", "block"),
    Rule("xxx", "*.xxx/**", "block"),
    Rule("casino", "*casino*/**", "block"),
    Rule("login", "**/wp-login.php", "block"),
    Rule("exe", "**.exe", "block"),
    Rule("apk", "**.apk", "block"),
    Rule("zip", "**.zip", "block"),
]


class ShiftAnd:
    """The rules' states as bits of ``words`` 64-bit words; one state is set once the part of its rule before it has been
    read. A step shifts all states by one byte and keeps those whose byte fits, and those that wait in a wildcard."""

    def __init__(self, globs: Sequence[str]):
        tokens, starts, ends = [], [], []
        for g in globs:
            starts.append(len(tokens))
            tokens.append([None, None])  # the start state: no byte leads to it
            for t in re.findall(r"\*\*|\*|[^*]", g, re.S):
                if t == "**":
                    tokens[-1][1] = "any"
                elif t == "*":
                    tokens[-1][1] = tokens[-1][1] or "inner"
                else:
                    tokens += [[b if t != "?" else "?", None] for b in t.encode()]
            ends.append(len(tokens) - 1)
        self.words = max(1, -(-len(tokens) // 64))
        self.step = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        slash = ord("/")
        for i, (byte, loop) in enumerate(tokens):
            w, bit = i // 64, np.uint64(1 << (i % 64))
            if byte == "?":
                self.step[:, w] |= bit
                self.step[slash, w] &= ~bit
            elif byte is not None:
                self.step[byte, w] |= bit
            if loop:
                self.stay[:, w] |= bit
                if loop == "inner":
                    self.stay[slash, w] &= ~bit
        self.start = np.zeros(self.words, np.uint64)
        for i in starts:
            self.start[i // 64] |= np.uint64(1 << (i % 64))
        self.ends = [(i // 64, np.uint64(1 << (i % 64))) for i in ends]

    def match(self, texts: Sequence[bytes], cells: int = 1 << 22) -> np.ndarray:
        """(texts, rules) booleans. Texts of like length run together, at most ``cells`` bytes at once."""
        found = np.zeros((len(texts), len(self.ends)), bool)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        at = 0
        while at < len(order):
            longest = max(1, int(sizes[order[at]]))
            rows = order[at : at + max(1, cells // longest)]
            found[rows] = self._run([texts[i] for i in rows], sizes[rows])
            at += len(rows)
        return found

    def _run(self, texts: list[bytes], sizes: np.ndarray) -> np.ndarray:
        longest = int(sizes[0]) if len(sizes) else 0
        grid = np.frombuffer(b"".join(t.ljust(longest, b"\0") for t in texts), np.uint8).reshape(len(texts), longest)
        state = np.tile(self.start, (len(texts), 1))
        one, top = np.uint64(1), np.uint64(63)
        for j in range(longest):
            k = int(np.searchsorted(-sizes, -j))  # texts longer than j, as they come longest first
            s, c = state[:k], grid[:k, j]
            moved = s << one
            moved[:, 1:] |= s[:, :-1] >> top
            state[:k] = (moved & self.step[c]) | (s & self.stay[c])
        return np.stack([(state[:, w] & bit) != 0 for w, bit in self.ends], axis=1)


def split_url(url: str | None) -> tuple[str, str]:
    found = _URL.search(url or "")
    return (found[1].translate(_LOWER), found[2]) if found else ("", "")


def judge_urls(pages: DataFrame, rules: Sequence[Rule] = BASE_RULES, defaults: Sequence[Rule] = DEFAULT_RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and matched (names of all rules that fit) of every row of ``pages``.

    The longest fitting rule decides (of equally long ones the first); without one, any fitting default blocks or allows by
    the same order, and urls that nothing fits are allowed. A null url, or one without ``://``, has an empty host and path
    and is allowed. Repeated rows are judged each; other columns are not read."""
    rules = sorted(rules, key=lambda r: -len(r.name))
    everything = [*rules, *defaults]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ShiftAnd([r.glob for r in everything])
        names = np.array([r.name for r in everything], object)
        for b in batches:
            parts = [split_url(u) for u in b.column("url").to_pylist()]
            hits = machine.match([f".{h}{p}".encode("utf-8", "surrogatepass") if h or p else b"" for h, p in parts])
            first = [int(np.argmax(x)) if x.any() else -1 for x in hits]
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": b.column("page_id"),
                    "host": [h for h, _ in parts],
                    "path": [p for _, p in parts],
                    "rule": pa.array([names[i] if 0 <= i < len(rules) else None for i in first], pa.string()),
                    "verdict": [everything[i].verdict if i >= 0 else "allow" for i in first],
                    "matched": pa.array([list(names[x]) for x in hits], pa.list_(pa.string())),
                }
            )

    schema = "page_id long, host string, path string, rule string, verdict string, matched array<string>"
    return pages.select(F.col("page_id").cast("long"), "url").mapInArrow(run, schema)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, translate(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(url, '://([^/?#]*)([^?#]*)', 2) AS path FROM pages),
c AS (SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, '.' || coalesce(host, '') || coalesce(path, '') AS s FROM u),
r AS (SELECT *, [
    CASE WHEN regexp_matches(s, '^[^/]*\.example\.org/en/1') THEN 'example.org/en/1' END,
    CASE WHEN regexp_matches(s, '^[^/]*\.example\.org/es/') THEN 'example.org/es/' END,
    CASE WHEN regexp_matches(s, '^[^/]*\.com/fr/') THEN 'com/fr/' END,
    CASE WHEN regexp_matches(s, '^[^/]*\.com/de/') THEN 'com/de/' END,
    CASE WHEN regexp_matches(s, '^[^/]*\.org/') THEN 'org/' END] AS hits,
  [CASE WHEN regexp_matches(s, '^[^/]*spam[^/]*/') THEN 'spam' END,
   CASE WHEN regexp_matches(s, '^[^/]*\.xxx/') THEN 'xxx' END,
   CASE WHEN regexp_matches(s, '^[^/]*casino[^/]*/') THEN 'casino' END,
   CASE WHEN regexp_matches(s, '/wp-login\.php$') THEN 'login' END,
   CASE WHEN regexp_matches(s, '\.exe$') THEN 'exe' END,
   CASE WHEN regexp_matches(s, '\.apk$') THEN 'apk' END,
   CASE WHEN regexp_matches(s, '\.zip$') THEN 'zip' END] AS more FROM c),
f AS (SELECT *, coalesce(hits[1], hits[2], hits[3], hits[4], hits[5]) AS rule FROM r)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN len(list_filter(more, lambda x: x IS NOT NULL)) > 0 THEN 'block' ELSE 'allow' END AS verdict,
  list_filter(hits || more, lambda x: x IS NOT NULL) AS matched
FROM f
"""
