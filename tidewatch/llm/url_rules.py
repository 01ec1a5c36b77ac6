"""URL filters: a trie over reversed host labels and path segments, longest match wins.

Rules are (host, path, verdict). A rule fits its host and every subdomain whose url path starts
with the rule's path; among the fitting rules the longest host + path wins (ties: the longer host,
then block before allow, so the order of the rules never matters).

The trie is broadcast only while the rule set is within `max_broadcast_rules`; a larger set is
joined instead: each distinct url explodes into its host suffixes x directory prefixes and meets
the rules by equality, so neither side needs to fit one task.

Null urls and urls without `://` have an empty host and path and fit no rule.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)).otherwise("")


def _rest(url: Column) -> Column:
    return F.substr(url, F.instr(url, "://") + 3)


def path_of(url: Column) -> Column:
    """From the end of the host up to `?`, `#` or the end."""
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def build_trie(rules: Sequence[Rule]) -> dict:
    """Nested dicts: host labels from the right, then "" leads to the path trie of that host.

    In a path trie a key is a whole directory (`en/`); "" holds the remainders of rules that end
    inside a segment or exactly here (remainder ""): the lengths that occur, ascending, and by remainder
    the rule text and verdict. A url is looked up once per length, however many rules a folder has.
    """
    root: dict = {}
    for host, path, verdict in rules:
        node = root
        for label in reversed(host.split(".")):
            node = node.setdefault(label, {})
        node = node.setdefault("", {})
        *folders, last = path.split("/")
        for folder in folders:
            node = node.setdefault(folder + "/", {})
        lengths, ends = node.setdefault("", ([], {}))
        if last not in ends or verdict == "block":
            ends[last] = (host + path, verdict)
        if len(last) not in lengths:
            insort(lengths, len(last))
    return root


def match(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """The winning rule's text and verdict, or (None, None)."""
    best: tuple = (-1, -1, "", None, None)
    node, depth = trie, 0
    *folders, last = path.split("/")
    for label in reversed(host.split(".")) if host else ():
        node = node.get(label)
        if node is None:
            break
        depth += len(label) + 1
        at = node.get("")
        seen = 0
        for folder in [*folders, None]:
            if at is None:
                break
            lengths, ends = at.get("", ((), {}))
            for length in lengths:
                if seen + length > len(path):
                    break
                found = ends.get(path[seen : seen + length])
                if found:
                    rule, verdict = found
                    best = max(best, (len(rule), depth, verdict, rule, verdict), key=lambda x: x[:3])
            if folder is None:
                break
            at = at.get(folder + "/")
            seen += len(folder) + 1
    return best[3], best[4]


def judge_urls(
    df: DataFrame, rules: Sequence[Rule] | DataFrame, url: str = "url", default: str = "allow", max_broadcast_rules: int = 200_000
) -> DataFrame:
    """Adds host, path, rule (null if none fits) and verdict to every row of `df`, replacing columns of those names.

    `rules` is a list, or a DataFrame of (host, path, verdict); its count decides between the
    broadcast trie and the join.
    """
    spark = df.sparkSession
    parsed = df.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if isinstance(rules, DataFrame):
        n = rules.limit(max_broadcast_rules + 1).count()
        if n > max_broadcast_rules:
            return _judge_by_join(parsed, rules, default)
        rules = [tuple(r) for r in rules.select("host", "path", "verdict").collect()]
    elif len(rules) > max_broadcast_rules:
        return _judge_by_join(parsed, spark.createDataFrame(list(rules), "host string, path string, verdict string"), default)
    trie = spark.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for hosts, paths in batches:
            found = [match(trie.value, h, p) for h, p in zip(hosts, paths, strict=True)]
            yield pd.DataFrame({"rule": [r for r, _ in found], "verdict": [v or default for _, v in found]}, dtype=object)

    own = "_found"
    while own in df.columns:
        own = f"_{own}"
    return parsed.withColumn(own, judged("host", "path")).withColumns({"rule": F.col(own).rule, "verdict": F.col(own).verdict}).drop(own)


def _judge_by_join(parsed: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same answer by equality joins on (host suffix, directory prefix)."""
    keyed = rules.select(
        F.col("host").alias("_h"),
        F.regexp_extract("path", r"^(.*/)?", 0).alias("_d"),
        F.regexp_extract("path", r"[^/]*$", 0).alias("_rest"),
        F.concat("host", "path").alias("_rule"),
        F.col("verdict").alias("_verdict"),
    )
    urls = parsed.select(F.col("host").alias("_host"), F.col("path").alias("_path")).where("_host <> ''").distinct()
    labels, folders = F.split("_host", r"\."), F.split("_path", "/")
    places = (
        urls.withColumn("_l", F.explode(F.sequence(F.lit(1), F.size(labels))))
        .withColumn("_h", F.array_join(F.slice(labels, F.col("_l"), F.size(labels)), "."))
        .withColumn("_f", F.explode(F.sequence(F.lit(0), F.size(folders) - 1)))
        .withColumn("_d", F.when(F.col("_f") == 0, "").otherwise(F.concat(F.array_join(F.slice(folders, F.lit(1), F.col("_f")), "/"), F.lit("/"))))
    )
    best = (
        places.join(keyed, ["_h", "_d"])
        .where(F.expr("startswith(_path, concat(_d, _rest))"))
        .groupBy("_host", "_path")
        .agg(F.max(F.struct(F.length("_rule"), F.length("_h"), "_verdict", "_rule")).alias("_best"))
        .select(F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_best._rule").alias("rule"), F.col("_best._verdict").alias("verdict"))
    )
    return parsed.drop("rule", "verdict").join(best, ["host", "path"], "left").withColumn("verdict", F.coalesce("verdict", F.lit(default)))
