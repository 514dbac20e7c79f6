"""URL filters: hashed host-suffix and path-prefix expressions looked up in a rule table.

Each URL is expanded into every (host suffix, path prefix) pair that a rule could name. Pairs and
rules meet in an equi-join on the first 32 bits of a SHA-256 digest; the full digest then confirms
a match, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

# A rule table up to this size is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_BYTES = 8_000_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first ``://`` in lower case (A-Z), and the path up to ``?`` or ``#``.

    Both are empty for a null url and for one without ``://``.
    """
    text = F.coalesce(url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    host = F.regexp_extract(text, shape, 1)
    return F.translate(host, UPPER, UPPER.lower()), F.regexp_extract(text, shape, 2)


def _digest(host: Column, path: Column) -> Column:
    # Neither part of a URL can hold "?".
    return F.sha2(F.concat(host, F.lit("?"), path), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path) with its digest; of contradicting rules, block holds.

    Rules without a host fit nothing and go; a null path means every path, a null verdict block.
    """
    host = F.translate(F.col("host"), UPPER, UPPER.lower())
    named = rules.filter("host is not null and host != ''").select(
        host.alias("_rhost"),
        F.coalesce("path", F.lit("")).alias("_rpath"),
        F.coalesce("verdict", F.lit("block")).alias("_rverdict"),
    )
    merged = named.groupBy("_rhost", "_rpath").agg(F.max("_rverdict").alias("_rverdict"))
    digest = _digest(F.col("_rhost"), F.col("_rpath"))
    return merged.withColumn("_rdigest", digest).withColumn(
        "_rshort", F.substring("_rdigest", 1, 8)
    )


def _shapes(rules: DataFrame) -> dict:
    """What the rules can name: labels per host, slashes or characters per path; their size.

    One row. The lists hold distinct lengths of rule paths, so the longest path bounds them.
    """
    slashes = F.length("_rpath") - F.length(F.replace("_rpath", F.lit("/")))
    closed = F.col("_rpath").endswith("/")
    row = rules.agg(
        F.max(F.size(F.split("_rhost", r"\."))).alias("labels"),
        F.collect_set(F.when(closed, slashes)).alias("slashes"),
        F.collect_set(F.when(~closed, F.length("_rpath"))).alias("lengths"),
        F.sum(F.octet_length("_rhost") + F.octet_length("_rpath") + 160).alias("bytes"),
    ).first()
    return row.asDict()


def _expand(host: Column, path: Column, shapes: dict) -> Column:
    """Array of (short, digest) of every pair of host suffix and path prefix a rule could name."""
    labels = F.split(host, r"\.")
    most = F.least(F.size(labels), F.lit(shapes["labels"] or 1))
    suffixes = F.when(
        host != "",
        F.transform(
            F.sequence(F.lit(1), most),
            lambda i: F.array_join(F.slice(labels, F.size(labels) - i + 1, i), "."),
        ),
    ).otherwise(F.array().cast("array<string>"))
    cuts = [
        F.when(
            F.length(path) - F.length(F.replace(path, F.lit("/"))) >= k,
            F.concat(F.substring_index(path, "/", k), F.lit("/")),
        )
        for k in sorted(shapes["slashes"])
    ] + [
        F.when(F.length(path) >= n, F.substring(path, 1, n) if n else F.lit(""))
        for n in sorted(shapes["lengths"])
    ]
    prefixes = F.array_compact(F.array(*cuts)) if cuts else F.array().cast("array<string>")
    return F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p)))
    )


def _spread(pairs: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the shuffle join with a salt; prefixes that many URLs share use all salts.

    At most one prefix per partition can be that frequent, so the list of them is small.
    """
    n = max(2, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = pairs.filter("_short is not null")
    hot = asked.groupBy(F.col("_short").alias("_hot")).count()
    total = asked.agg((F.count("*") / n).alias("_share"))
    hot = hot.join(F.broadcast(total), F.col("count") > F.col("_share")).select("_hot")
    hot = F.broadcast(hot)
    salt = F.when(F.col("_hot").isNotNull(), F.pmod(F.xxhash64("_row"), F.lit(n))).otherwise(0)
    pairs = pairs.join(hot, F.col("_short") == F.col("_hot"), "left").withColumn("_salt", salt)
    top = F.when(F.col("_hot").isNotNull(), F.lit(n - 1)).otherwise(0).cast("bigint")
    rules = rules.join(hot, F.col("_rshort") == F.col("_hot"), "left")
    rules = rules.withColumn("_rsalt", F.explode(F.sequence(F.lit(0).cast("bigint"), top))).drop("_hot")
    return pairs.drop("_hot"), rules


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    url: str = "url",
    keep: list[str] | None = None,
    default: str = "allow",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``keep`` columns of every page, with host, path, rule and verdict.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all subdomains
    if the path of the URL starts with the rule's path; the longest rule (host and path together,
    then host) decides, and ``default`` where none fits. Every input row gives one output row,
    repeated rows too. A null, empty or relative URL has empty host and path and gets ``default``;
    an empty rule table gives ``default`` throughout. A kept column named like a result column is
    replaced by the result.

    Rows are numbered and written once. Expansions stay in the task that read them: only one small row per page
    is shuffled.
    """
    added = ["host", "path", "rule", "verdict"]
    keep = [c for c in (pages.columns if keep is None else keep) if c not in added]
    rules = prepare_rules(rules)
    shapes = _shapes(rules)
    host, path = host_and_path(F.col(f"`{url}`"))
    # Row numbers depend on how rows were placed: written down, so that a lost executor cannot change them.
    rows = stage(
        pages.select(
            (F.struct(*[F.col(f"`{c}`") for c in keep]) if keep else F.lit(0)).alias("_kept"),
            host.alias("_host"),
            path.alias("_path"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "url-rows",
    )
    pairs = rows.withColumn(
        "_digest", F.explode_outer(_expand(F.col("_host"), F.col("_path"), shapes))
    ).withColumn("_short", F.substring("_digest", 1, 8))
    on = (F.col("_short") == F.col("_rshort")) & (F.col("_digest") == F.col("_rdigest"))
    if (shapes["bytes"] or 0) <= broadcast_bytes:
        met = pairs.join(F.broadcast(rules), on, "left")
    else:
        pairs, rules = _spread(pairs, rules)
        met = pairs.join(rules, on & (F.col("_salt") == F.col("_rsalt")), "left")
    rule = F.when(
        F.col("_rdigest").isNotNull(),
        F.struct(
            (F.length("_rhost") + F.length("_rpath")).alias("size"),
            F.length("_rhost").alias("host_size"),
            F.concat("_rhost", "_rpath").alias("name"),
            F.col("_rverdict").alias("verdict"),
        ),
    )
    best = met.groupBy("_row").agg(
        F.first("_kept").alias("_kept"),
        F.first("_host").alias("host"),
        F.first("_path").alias("path"),
        F.max(rule).alias("_best"),
    )
    return best.select(
        *[F.col(f"_kept.`{c}`").alias(c) for c in keep],
        "host",
        "path",
        F.col("_best.name").alias("rule"),
        F.coalesce("_best.verdict", F.lit(default)).alias("verdict"),
    )
