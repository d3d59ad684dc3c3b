"""URL filters: glob rules as one bit-parallel wildcard automaton.

All rules are packed into the bits of a few 64-bit words (Shift-And).  A state
bit stands for a position in a rule; ``*`` is a self-loop on the bit before it.
One step per byte moves every rule over a whole batch of URLs at once, so the
cost is bytes * ceil(rule bits / 64), whatever the number of rules.

The canonical URL is ``.host/path``.  The leading dot lets one glob
``*.example.org/x*`` fit the host and all its subdomains, and the host part's
``*`` does not cross a slash.

Defined results: a null url or one without ``://`` has an empty host and path
and gets ``default``; several longest rules that fit cannot differ, as rules are
distinct and of equal text; a rule list may be empty; repeated rows are judged
alike; other columns are passed through, clashing names replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, text_chunks

#: (verdict, host, path prefix): the fixed rules of the op5 contract.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


class GlobAutomaton:
    """Shift-And masks of host/path rules."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        # the longest first: the lowest accepting rule wins
        self.rules = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
        texts = [("." + host + path).encode() for _, host, path in self.rules]
        self.bits = sum(len(t) + 1 for t in texts)
        self.words = max(1, -(-self.bits // 64))
        table = np.zeros((256, self.words), U)
        loop = np.zeros((256, self.words), U)
        self.first = np.zeros(self.words, U)
        self.accept: list[tuple[int, U]] = []
        at = 0
        for t in texts:
            # bit `at`: before the rule's text; the host's star holds it on all but a slash
            self._set(self.first, at)
            for b in range(256):
                if b != 0x2F:
                    self._set(loop[b], at)
            for k, b in enumerate(t):
                self._set(table[b], at + k + 1)
            last = at + len(t)
            loop[:, last // 64] |= U(1) << U(last % 64)  # the path's trailing star
            self.accept.append((last // 64, U(1) << U(last % 64)))
            at += len(t) + 1
        self.table, self.loop = table, loop

    @staticmethod
    def _set(row: np.ndarray, bit: int) -> None:
        row[bit // 64] |= U(1) << U(bit % 64)

    def longest(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Index of the longest rule that fits each string, or -1."""
        n = len(start)
        order = np.argsort(-length, kind="stable")
        start, length = start[order], length[order]
        state = np.tile(self.first, (n, 1))
        live = n
        for k in range(int(length[0]) if n else 0):
            live = int(np.searchsorted(-length[:live], -k, side="left"))
            c = data[start[:live] + k]
            d = state[:live]
            up = d << U(1)
            up[:, 1:] |= d[:, :-1] >> U(63)
            state[:live] = (up & self.table[c]) | (d & self.loop[c])
        out = np.full(n, -1)
        for r in range(len(self.accept) - 1, -1, -1):
            w, m = self.accept[r]
            out[(state[:, w] & m) != 0] = r
        back = np.empty(n, np.int64)
        back[order] = out
        return back


def split_url(url):
    """(host, path) columns of a url column."""
    u = F.coalesce(url, F.lit(""))
    host = F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def url_filter(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", default: str = "allow") -> DataFrame:
    """df with host, path, rule and verdict; no shuffle."""
    host, path = split_url(F.col(url))
    base = df.drop(*[c for c in df.columns if c.lower() in ("host", "path", "rule", "verdict")]).withColumns({"host": host, "path": path})
    schema = base.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit("")}).schema

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = GlobAutomaton(list(rules))
        names = np.array([h + p for _, h, p in auto.rules] + [None], dtype=object)
        verdicts = np.array([v for v, _, _ in auto.rules] + [default], dtype=object)
        for b in batches:
            canonical = pc.binary_join_element_wise(pa.scalar("."), b.column("host"), b.column("path"), "")
            hits = [auto.longest(data, off[:-1], np.diff(off)) for _, _, data, off in text_chunks(canonical)]
            hit = np.concatenate(hits) if hits else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names[hit], pa.string()), pa.array(verdicts[hit], pa.string())], names=[*b.schema.names, "rule", "verdict"])

    return base.mapInArrow(judge, schema)


def oracle_sql() -> str:
    """DuckDB SQL for op5, from the rules alone."""
    values = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    return f"""
with u as (select page_id, lower(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)) as host,
                  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
     r(v, h, p) as (values {values})
select page_id, host, path,
       (select h || p from r where ('.' || host) like ('%.' || h) and starts_with(path, p) order by length(h || p) desc limit 1) as rule,
       coalesce((select v from r where ('.' || host) like ('%.' || h) and starts_with(path, p) order by length(h || p) desc limit 1), 'allow') as verdict
from u"""
