"""URL rules by a sort-merge range join.

A host's labels in reverse, each closed by a dot, are its key; the hosts a rule covers are then one interval of keys,
those that start with the rule's own. Rules and urls are sorted by key and swept together, with a stack of the rules
whose interval the sweep is in; rules on the stack are nested. A url takes the deepest rule whose path its own path
starts with.

Up to ``max_rules`` rules are carried to every task, which sweeps its own rows: no shuffle. Beyond that both sides are
dealt into ranges of keys; a rule goes to every range that its interval meets, and ranges with many urls are salted.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import merge

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vesselspark.llm.common import ascii_lower

MAX_RULES = 100_000
SCHEMA = "id long, host string, path string, rule string, verdict string"
Rule = tuple[str, str, str, str]  # key, path, name, action


def url_host(url: Column) -> Column:
    """After the first ``://`` up to a slash, question or number sign; empty if there is none, or for null."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """From the end of the host up to a question or number sign."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    return ".".join(reversed(host.split("."))) + "."


def sweep(events: Iterable[tuple]) -> Iterator[tuple]:
    """Events (key, 0, rule) and (key, 1, (id, host, path)) in order of key, rules first -> result rows."""
    stack: list[tuple[str, dict[str, tuple[str, str]], list[int]]] = []  # key, rules by path, path lengths falling
    for key, is_url, body in events:
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        if not is_url:
            if not stack or stack[-1][0] != key:
                stack.append((key, {}, []))
            _, rules, lengths = stack[-1]
            own = rules.get(body[1])
            if own is None or body[2:] < own:  # of equal rules the first by name and action
                rules[body[1]] = body[2:]
                lengths[:] = sorted({len(p) for p in rules}, reverse=True)
            continue
        name, action = None, "allow"
        for _, rules, lengths in reversed(stack):
            found = next((r for n in lengths if (r := rules.get(body[2][:n])) and len(body[2]) >= n), None)
            if found:
                name, action = found
                break
        yield (*body, name, action)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string())
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["id", "host", "path", "rule", "verdict"])


def _carried(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    fixed = urls.sparkSession.sparkContext.broadcast(sorted((r[0], 0, r) for r in rules))  # at most max_rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            rows = sorted(((host_key(r[1]), 1, r) for r in zip(*columns)), key=lambda e: e[0])
            yield _batch(list(sweep(merge(fixed.value, rows, key=lambda e: e[:2]))))

    return urls.mapInArrow(run, SCHEMA)


def _ranged(urls: DataFrame, rules: DataFrame, ranges: int) -> DataFrame:
    """Cuts between ranges are rule keys; there are at most ``ranges`` of them, and as many url counts."""
    keyed = urls.withColumn("key", _key_column("host"))
    keys = [r.key for r in rules.select("key").distinct().orderBy(F.xxhash64("key")).limit(ranges).collect()]
    cuts = F.array_sort(F.array(*[F.lit(k) for k in keys]))
    part = lambda key: F.size(F.filter(cuts, lambda cut: cut <= key))
    keyed = keyed.withColumn("part", part(F.col("key")))
    counts = {r.part: r["count"] for r in keyed.groupBy("part").count().collect()}
    most = max(1, sum(counts.values()) // (2 * ranges))
    salts = F.array(*[F.lit(-(-counts.get(k, 0) // most) or 1) for k in range(len(keys) + 1)])
    left = keyed.select("part", F.pmod(F.xxhash64("id", "host", "path"), F.element_at(salts, F.col("part") + 1)).cast("int").alias("salt"),
                        "key", F.lit(1).alias("is_url"), "id", "host", "path", F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("action"))
    spread = rules.withColumn("part", F.explode(F.sequence(part(F.col("key")), part(F.concat("key", F.lit("\U0010ffff"))))))
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.element_at(salts, F.col("part") + 1) - 1)))
    right = spread.select("part", "salt", "key", F.lit(0).alias("is_url"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("host"), "path", "name", "action")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def events() -> Iterator[tuple]:
            for batch in batches:
                for part, salt, key, is_url, doc, host, path, name, action in zip(*(c.to_pylist() for c in batch.columns)):
                    yield f"{part}/{salt}/{key}", is_url, (doc, host, path) if is_url else (key, path, name, action)

        rows = []
        for row in sweep(events()):
            rows.append(row)
            if len(rows) == 4096:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    both = left.unionByName(right).repartition(2 * ranges, "part", "salt").sortWithinPartitions("part", "salt", "key", "is_url")
    return both.mapInArrow(run, SCHEMA)


def _key_column(host: str) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", max_rules: int = MAX_RULES, ranges: int = 200) -> DataFrame:
    """``(id, host, path, rule, verdict)`` of every row's url. ``rules(host, path, action)``: a rule covers its host and
    all hosts below it where the url's path starts with the rule's; the longest host wins, then the longest path, and of
    equal rules the first action by name. Without a rule the verdict is allow. Rules with a null field or an empty host
    are not used; null and repeated ids keep their rows; other columns are not read. A url of any length is taken whole; an
    empty table gives none, and without rules all are allowed."""
    urls = pages.select(F.col(id_col).cast("long").alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    usable = rules.where("host <> '' and path is not null and action is not null").select(ascii_lower(F.col("host")).alias("host"), "path", "action")
    keyed = usable.select(_key_column("host").alias("key"), "path", F.concat("host", "path").alias("name"), "action")
    few = keyed.limit(max_rules + 1).collect()
    if len(few) <= max_rules:
        return _carried(urls, [tuple(r) for r in few])
    return _ranged(urls, keyed, ranges)
