"""URL filters by lists that change over time: an as-of join of captures with the validity intervals of list entries.

A list is a log of changes: an entry is added to it on one day and removed on another, perhaps again and again.  The
log becomes disjoint intervals for each (list, entry), and a capture is judged by the entries valid at its own time,
``valid_from <= captured < valid_to``, not by those of today.

An entry is a domain, or a domain and a path.  It covers a URL whose host is the domain or below it and whose path
starts with the entry's, by whole segments.  An entry thus has a shape, the number of its labels and of its segments,
and a URL has at most one key of each shape: keys are made for the shapes that the lists have, and joined by equality.
All intervals of a key lie in one row of the joined table, so that no pairs of captures and intervals are made.

Whether a URL is covered depends on the URL and the time alone.  Distinct (url, captured) are judged, and the
verdicts joined back to every row, so that null and repeated ids need no care.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .names import other_columns_apart

#: Entries that are sent to every task at most; beyond, the join is by shuffle.
BROADCAST_BOUND = 100_000

_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:(?=//)")
_NO_HOST = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*:(?!//|[0-9]*(?:[/?#]|$))")  # such as mailto:, but not a port
_ESCAPE = re.compile(r"%([0-9A-Fa-f]{2})")
_UNRESERVED = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~")
_NUMERIC = re.compile(r"[0-9]+(?:\.[0-9]+){3}|\[.*\]")


def _plain_escape(m: re.Match) -> str:
    ch = chr(int(m[1], 16))
    return ch if ch in _UNRESERVED else m[0].upper()


def parts(url: str | None) -> tuple[list[str], list[str]] | None:
    """(labels of the host, segments of the path) in one spelling; None if there is no host.

    Scheme, user, port, query and fragment don't count, nor do empty and dot segments.
    """
    if url is None:
        return None
    rest = url.strip().replace("\\", "/")
    if _NO_HOST.match(rest):
        return None
    rest = rest[m.end() :] if (m := _SCHEME.match(rest)) else rest
    rest = re.split("[?#]", rest.removeprefix("//"), maxsplit=1)[0]
    host, _, path = rest.partition("/")
    host = re.sub(r":[0-9]*$", "", host.rpartition("@")[2]).rstrip(".").lower()
    if not host:
        return None
    if not host.isascii():
        try:
            host = host.encode("idna").decode()
        except UnicodeError:
            pass
    segments: list[str] = []
    for x in _ESCAPE.sub(_plain_escape, path).split("/"):
        if x == "..":
            del segments[-1:]
        elif x not in ("", "."):
            segments.append(x)
    return [host] if _NUMERIC.fullmatch(host) else host.split("."), segments


def key(labels: list[str], segments: list[str]) -> str:
    return "/".join([".".join(labels), *segments])


def intervals(log: DataFrame) -> DataFrame:
    """(key, n_labels, n_segments, list, valid_from, valid_to) of a log (list, entry, at, action).

    action is ``add`` or ``remove``, the later of a day's two.  valid_to is null while an entry stands.  Entries are
    told apart in one spelling; those without a host or a day are no entries.
    """
    ship(log.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parts(x) for x in batch.column("entry").to_pylist()]
            more = [pa.array([x and key(*x) for x in found], pa.string()), *(pa.array([x and len(x[k]) for x in found], pa.int32()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays([*more, *(batch.column(c) for c in ("list", "at", "action"))], names=["key", "n_labels", "n_segments", "list", "at", "action"])

    rows = log.select(F.col("list").cast("string").alias("list"), F.col("entry").cast("string").alias("entry"), F.col("at").cast("date").alias("at"), F.col("action").cast("string").alias("action"))
    rows = rows.mapInArrow(run, "key string, n_labels int, n_segments int, list string, at date, action string")
    rows = rows.where("key IS NOT NULL AND at IS NOT NULL AND action IN ('add', 'remove')")
    order = Window.partitionBy("list", "key").orderBy("at", "action")
    rows = rows.withColumn("valid_to", F.lead("at").over(order)).where("action = 'add' AND (valid_to IS NULL OR at < valid_to)")
    return rows.select("key", "n_labels", "n_segments", "list", F.col("at").alias("valid_from"), "valid_to")


def candidates(captures: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """(url, captured, key): the keys that a URL has in the given shapes, for distinct (url, captured)."""
    ship(captures.sparkSession)
    rows = captures.select("url", "captured").where("url IS NOT NULL AND captured IS NOT NULL").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = []
            for url in batch.column("url").to_pylist():
                labels, segments = parts(url) or ([], [])
                keys.append([key(labels[len(labels) - a :], segments[:b]) for a, b in shapes if a <= len(labels) and b <= len(segments)])
            yield pa.RecordBatch.from_arrays([batch.column("url"), batch.column("captured"), pa.array(keys, pa.list_(pa.string()))], names=["url", "captured", "keys"])

    return rows.mapInArrow(run, "url string, captured date, keys array<string>").select("url", "captured", F.explode("keys").alias("key"))


@other_columns_apart("url", "captured", made=("n_lists", "lists", "entry", "blocked"))
def judge(captures: DataFrame, log: DataFrame, bound: int = BROADCAST_BOUND) -> DataFrame:
    """``captures`` (with url and captured) and n_lists, lists, entry and blocked.

    lists are the names of the lists that cover the URL at its time, sorted and joined by commas; entry is the valid
    entry of most segments, then labels, that does (the first by name of several).  A null URL or time is covered by
    nothing, and every row is kept, repeated ones too.  Columns of the four names are replaced, names of others don't matter; empty
    captures give none, an empty log blocks nothing.
    """
    valid = intervals(log)
    table = valid.groupBy("key", "n_labels", "n_segments").agg(F.collect_list(F.struct("list", "valid_from", "valid_to")).alias("_spans"))
    shapes = [(a, b) for a, b, _ in valid.groupBy("n_labels", "n_segments").count().collect()]  # few: labels by segments
    if valid.count() <= bound:
        table = F.broadcast(table)
    times = captures.withColumn("captured", F.col("captured").cast("date"))
    found = candidates(times, shapes).join(table, "key")
    found = found.withColumn("_lists", F.expr("transform(filter(_spans, x -> x.valid_from <= captured AND (x.valid_to IS NULL OR captured < x.valid_to)), x -> x.list)")).where(F.size("_lists") > 0)
    found = found.groupBy(F.col("url").alias("_url"), F.col("captured").alias("_captured")).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("_lists")))).alias("_lists"),
        F.min(F.struct(-F.col("n_segments"), -F.col("n_labels"), "key"))["key"].alias("entry"),
    )
    rows = times.join(found, (F.col("url") == F.col("_url")) & (F.col("captured") == F.col("_captured")), "left")
    lists = F.coalesce("_lists", F.array().cast("array<string>"))
    return rows.select(*times.columns, F.size(lists).cast("long").alias("n_lists"), F.array_join(lists, ",").alias("lists"), "entry", (F.size(lists) > 0).alias("blocked"))


#: The test data have neither capture times nor lists.  A page's time follows from its id, and the log from the md5 of
#: the hosts, their domains and their first folders: each enters a list on some day, most leave it, and some return.
CAPTURES = "SELECT page_id, url, CAST(date_add(DATE'2024-01-01', CAST(pmod(page_id * 7919, 366) AS INT)) AS DATE) AS captured FROM {pages}"
_NAMES = r"""
h AS (SELECT DISTINCT regexp_extract(url, '^https?://([a-z0-9.-]+)', 1) AS host, regexp_extract(url, '^https?://[a-z0-9.-]+/([a-z0-9]+)/', 1) AS folder FROM {pages} WHERE url IS NOT NULL),
e AS (SELECT DISTINCT 'spam' AS list, host AS entry FROM h WHERE host <> ''
      UNION ALL SELECT DISTINCT 'adult', regexp_extract(host, '([a-z0-9-]+[.][a-z0-9-]+)$', 1) FROM h WHERE host LIKE '%.%'
      UNION ALL SELECT DISTINCT 'scam', concat(host, '/', folder) FROM h WHERE host <> '' AND folder <> ''),
x AS (SELECT list, entry, substr(md5(entry), 1, 1) AS a, substr(md5(entry), 2, 1) AS b, {day} AS day FROM e),
c AS (SELECT list, entry, day, 'add' AS action FROM x WHERE list = 'adult' OR a < '8'
      UNION ALL SELECT list, entry, day + 40, 'remove' FROM x WHERE list = 'adult' OR (a < '8' AND b < 'c')
      UNION ALL SELECT list, entry, day + 70, 'add' FROM x WHERE a < '8' AND b < '6')"""
LOG = "WITH " + _NAMES.replace("{day}", "CAST(conv(substr(md5(entry), 3, 2), 16, 10) AS INT)") + " SELECT list, entry, date_add(DATE'2024-01-01', day) AS at, action FROM c"

#: DuckDB's form of the query, by pairs.
ORACLE = (
    "WITH "
    + _NAMES.replace("{pages}", "pages").replace("{day}", "CAST('0x' || substr(md5(entry), 3, 2) AS INT)")
    + r""",
v AS (SELECT list, entry, DATE '2024-01-01' + day AS valid_from, DATE '2024-01-01' + lead(day) OVER (PARTITION BY list, entry ORDER BY day, action) AS valid_to, action FROM c),
p AS (SELECT page_id, url, DATE '2024-01-01' + CAST((page_id * 7919) % 366 AS INT) AS captured, '.' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || '/' AS u FROM pages),
m AS (SELECT DISTINCT p.url, p.captured, list, entry FROM p JOIN v ON action = 'add' AND valid_from <= captured AND (valid_to IS NULL OR captured < valid_to)
      AND split_part(p.u, '/', 1) LIKE '%.' || split_part(entry, '/', 1) AND (entry NOT LIKE '%/%' OR split_part(p.u, '/', 2) = split_part(entry, '/', 2))),
g AS (SELECT url, captured, count(DISTINCT list) AS n_lists, string_agg(DISTINCT list, ',' ORDER BY list) AS lists,
             arg_min(entry, (-(len(entry) - len(replace(entry, '/', ''))) * 1000 - (len(entry) - len(replace(entry, '.', ''))))) AS entry FROM m GROUP BY ALL)
SELECT page_id, strftime(p.captured, '%Y-%m-%d') AS captured, coalesce(n_lists, 0)::BIGINT AS n_lists, coalesce(lists, '') AS lists, entry, coalesce(n_lists, 0) > 0 AS blocked
FROM p LEFT JOIN g ON p.url = g.url AND p.captured = g.captured
"""
)
