"""URL filters: a trie over reversed host labels, then path segments; the longest match wins.

A null url, or one without "://", has an empty host and path and is allowed with a null rule, as is any url that no
rule fits. Longest means most characters of host and path together, then of host; of equal rules the block entry wins.
A trie holds at most MOST_RULES rules, since it is broadcast; more raise an error. Repeated urls repeat, a null page_id
stays null; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Fixed values: (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Most rules one trie may hold.
MOST_RULES = 1_000_000
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
after_host = re.compile(r"[/?#]").search
after_path = re.compile(r"[?#]").search


class Trie:
    """Node: [children by host label, children by path segment, entry]. An entry's path ends inside a segment if it has no closing slash."""

    def __init__(self, rules):
        if len(rules) > MOST_RULES:
            raise ValueError(f"more than {MOST_RULES} rules")
        self.root = [{}, {}, []]
        for verdict, host, path in rules:
            node = self.root
            for label in reversed(host.split(".")):
                node = node[0].setdefault(label, [{}, {}, []])
            *whole, rest = path.split("/")
            for part in whole:
                node = node[1].setdefault(part, [{}, {}, []])
            node[2].append((len(host) + len(path), len(host), verdict == "block", rest, f"{host}{path}", verdict))

    def judge(self, host: str, path: str):
        found, node, parts = [], self.root, path.split("/")
        for label in reversed(host.split(".")) if host else ():
            node = node[0].get(label)
            if node is None:
                break
            inner = node
            for part in parts:
                found += [x for x in inner[2] if part.startswith(x[3])]
                inner = inner[1].get(part)
                if inner is None:
                    break
        if not found:
            return None, "allow"
        return max(found)[4:]


def split_url(url: str | None) -> tuple[str, str]:
    if not url or (p := url.find("://")) < 0:
        return "", ""
    rest = url[p + 3 :]
    at = m.start() if (m := after_host(rest)) else len(rest)
    tail = rest[at:]
    return rest[:at].translate(LOWER), tail[: m.start()] if (m := after_path(tail)) else tail


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict."""
    sent = pages.sparkSession.sparkContext.broadcast(Trie(rules))

    def run(batches):
        trie = sent.value
        for batch in batches:
            rows = [(i, *(hp := split_url(u)), *trie.judge(*hp)) for i, u in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist())]
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k else pa.int64()) for k, c in enumerate(cols)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


SQL = r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
h as (select page_id, rest, coalesce(regexp_extract(rest, '^[^/?#]*'), '') as raw from u),
p as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') as path from h)
select page_id, host, path,
 case when ('.' || host) like '%.example.net' and path like '/en/%' then 'example.net/en/' when ('.' || host) like '%.example.com' and path like '/de/%' then 'example.com/de/'
  when ('.' || host) like '%.org' and path like '/fr/%' then 'org/fr/' when ('.' || host) like '%.net' and path like '/%' then 'net/' end as rule,
 case when ('.' || host) like '%.example.net' and path like '/en/%' then 'allow' when ('.' || host) like '%.example.com' and path like '/de/%' then 'block'
  when ('.' || host) like '%.net' and path like '/%' then 'block' else 'allow' end as verdict from p"""
