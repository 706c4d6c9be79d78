"""URL filters by a sort-merge range join.

A rule (host, path) fits its host and all subdomains where the url's path starts
with the rule's. A host's labels are reversed and each label is closed by a
separator, so that ``com.example.`` and everything below it is one interval of
sorted keys; within a host the path prefix is again an interval. Each url gives
one key, (reversed suffix, path), for each of its host suffixes that is a rule's
host; suffixes with more labels than any rule are not formed. Keys and rule
intervals are sorted together and swept once; a stack holds the rules that are
open at the sweep line, nested ones on top, so the top is the longest that fits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Rules up to this number are sent to every task; more are dealt out by host.
MAX_BROADCAST_RULES = 100_000
#: Urls that a group sweeps, about.
GROUP_URLS = 20_000

SEPARATOR = "\x00"


def split_url(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where the url is null or has no ``://``."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)\A[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": host, "path": path})


def rule_key(host: str) -> str:
    """The labels of ``host`` from the last to the first, each closed by a separator."""
    return SEPARATOR.join(reversed(host.split("."))) + SEPARATOR


def suffix_keys(host: str, labels: Sequence[int]) -> Iterator[str]:
    """The keys of the suffixes of ``host`` that have one of these numbers of labels (sorted)."""
    last = host.rsplit(".", labels[-1])[-labels[-1] :] if labels else []
    for n in labels:
        if n <= len(last):
            yield SEPARATOR.join(reversed(last[-n:])) + SEPARATOR


def sweep(keys: list[tuple[str, str, int]], rules: list[tuple[str, str, int]]) -> Iterator[tuple[int, int]]:
    """Merges sorted (host key, path, row) with sorted (host key, path, rule); yields (row, longest rule that fits).

    A rule is open while keys have its host key and start with its path.
    """
    stack: list[tuple[str, str, int]] = []
    at, n = 0, len(rules)
    for host, path, row in keys:
        while at < n and rules[at][:2] <= (host, path):
            rule = rules[at]
            while stack and not (stack[-1][0] == rule[0] and rule[1].startswith(stack[-1][1])):
                stack.pop()
            stack.append(rule)
            at += 1
        while stack and not (stack[-1][0] == host and path.startswith(stack[-1][1])):
            stack.pop()
        if stack:
            yield row, stack[-1][2]


def longest(urls: Sequence[tuple[str, str]], rules: Sequence[tuple[str, str]]) -> list[int]:
    """The position in ``rules`` (distinct (host, path)) of the longest rule that fits each (host, path), else -1.

    A longer host comes before a longer path: it is the deeper interval.
    """
    known = sorted((rule_key(h), p, i) for i, (h, p) in enumerate(rules))
    hosts = {k for k, _, _ in known}
    labels = sorted({h.count(".") + 1 for h, _ in rules})  # suffixes of other numbers of labels have no rule
    keys = sorted((k, path, row) for row, (host, path) in enumerate(urls) for k in suffix_keys(host, labels) if k in hosts)
    best = [-1] * len(urls)
    depth = [(-1, -1)] * len(urls)
    for row, rule in sweep(keys, known):
        size = (len(rules[rule][0]), len(rules[rule][1]))
        if size > depth[row]:
            best[row], depth[row] = rule, size
    return best


def url_filter(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", max_broadcast_rules: int = MAX_BROADCAST_RULES) -> DataFrame:
    """All rows and columns of ``pages``, with host, path, rule (host + path of the longest rule that fits, else null) and verdict.

    ``rules`` has host, path and verdict ('allow' or 'block'); the host is taken
    in lower case, and of rules with the same host and path 'block' holds. Rules
    with a null host are left out and a null path is empty. A url that is null or
    has no ``://`` has an empty host and path and gets ``default``, as does one
    that no rule fits. Repeated pages each get their row; empty tables are fine;
    columns of ``pages`` named host, path, rule or verdict are replaced.
    """
    clean = rules.where("host is not null").groupBy(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path")).agg(F.max("verdict").alias("verdict"))
    given = split_url(pages.drop("host", "path", "rule", "verdict"), url_col)
    few = clean.limit(max_broadcast_rules + 1).collect()
    if len(few) <= max_broadcast_rules:
        table = pages.sparkSession.sparkContext.broadcast(sorted((r.host, r.path, r.verdict) for r in few))

        @F.arrow_udf("struct<rule string, verdict string>")
        def judge(host: pa.Array, path: pa.Array) -> pa.Array:
            rules = table.value
            best = longest(list(zip(host.to_pylist(), path.to_pylist())), [r[:2] for r in rules])
            found = [pa.array([rules[i][0] + rules[i][1] if i >= 0 else None for i in best], pa.string()), pa.array([rules[i][2] if i >= 0 else default for i in best], pa.string())]
            return pa.StructArray.from_arrays(found, names=["rule", "verdict"])

        return given.withColumn("_judged", judge("host", "path")).select(*given.columns, "_judged.rule", "_judged.verdict")
    return _dealt(given, clean, default)


def _dealt(given: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """Many rules: distinct (host, path) meet the rules of their host's suffixes in groups, and are swept there.

    A group has about ``GROUP_URLS`` of them however many there are: suffixes are dealt to as many
    bins as that takes, and the urls of a hot suffix to as many salts, each with all its rules.
    """
    most = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0  # labels that a rule has
    suffixes = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda i: F.call_function("substring_index", F.col("host"), F.lit("."), -i))
    urls = given.select("host", "path").distinct()
    probes = cut(urls.select("host", "path", F.explode(F.array_distinct(suffixes)).alias("suffix")).join(rules.select(F.col("host").alias("suffix")).distinct(), "suffix", "left_semi"))
    sizes = probes.groupBy("suffix").agg(F.ceil(F.count("*") / GROUP_URLS).cast("int").alias("salts"))
    bins = max(1, -(-probes.count() // GROUP_URLS))
    deal = F.pmod(F.xxhash64("suffix"), F.lit(bins))
    probes = probes.join(sizes, "suffix").select("suffix", "host", "path", deal.alias("deal"), F.pmod(F.xxhash64("host", "path"), F.col("salts")).cast("int").alias("salt"))
    dealt = rules.select(F.col("host").alias("suffix"), "path", "verdict").join(sizes, "suffix").withColumns({"deal": deal, "salt": F.explode(F.sequence(F.lit(0), F.col("salts") - 1))}).drop("salts")

    def run(keys: pa.Table, rules: pa.Table) -> pa.Table:
        rows, own = keys.to_pylist(), rules.to_pylist()
        known = sorted((rule_key(r["suffix"]), r["path"], i) for i, r in enumerate(own))
        found = list(sweep(sorted((rule_key(r["suffix"]), r["path"], i) for i, r in enumerate(rows)), known))
        hits = [{"host": rows[r]["host"], "path": rows[r]["path"], "rule": own[k]["suffix"] + own[k]["path"], "size": len(own[k]["suffix"]), "verdict": own[k]["verdict"]} for r, k in found]
        return pa.Table.from_pylist(hits, schema=pa.schema([("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("size", pa.int32()), ("verdict", pa.string())]))

    hits = probes.groupBy("deal", "salt").cogroup(dealt.groupBy("deal", "salt")).applyInArrow(run, "host string, path string, rule string, size int, verdict string")
    best = hits.groupBy("host", "path").agg(F.max(F.struct("size", F.length("rule").alias("n"), "rule", "verdict")).alias("best"))
    return given.join(best, ["host", "path"], "left").select(*given.columns, "best.rule", F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
