"""Robots exclusion (T8): URLs a host's rules disallow for our agent become
-9998 outcomes.

Rules (host, agent, allow, pattern) are joined to URLs on the host (an
equi-join), matched as anchored path patterns
(``*`` any run, trailing ``$`` end of URL), and resolved per URL: the
longest matching pattern wins, ``allow`` wins a tie, no match means allowed.
A group for our own agent replaces the ``*`` group of that host.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import col_of
from ..functions.urls import url_host

IGNORED_STATUS = -9998
WILDCARDS = 1000
_PATH_QUERY_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^#]*)"


def wildcard_parts(pattern) -> "F.Column":
    """A pattern with ``*`` or a final ``$`` as literal parts: struct (first, middle, last, ends).

    ``first`` must begin the path, the ``middle`` parts follow in order, and if ``ends``, ``last`` must end it.
    """
    p = col_of(pattern)
    ends = p.endswith("$")
    body = F.when(ends, F.substr(p, F.lit(1), F.length(p) - 1)).otherwise(p)
    parts = F.split(body, r"\*", -1)
    inner = F.slice(parts, F.lit(2), F.size(parts) - F.when(ends, 2).otherwise(1))
    return F.struct(
        F.get(parts, F.lit(0)).alias("first"),
        F.when(F.size(parts) == 1, F.array().cast("array<string>")).otherwise(F.filter(inner, lambda x: x != "")).alias("middle"),
        F.when(F.size(parts) > 1, F.get(parts, F.size(parts) - 1)).alias("last"),  # null: the pattern is one literal
        ends.alias("ends"))


def path_matches(path, parts) -> "F.Column":
    """Whether a path matches ``wildcard_parts``: each part is looked for behind the one before it, at its first place.

    No pattern is compiled, and a part is searched once per path, however many ``*`` there are.
    """
    p = col_of(path)
    behind = F.aggregate(  # position behind the last part found, 0 if one was not
        parts["middle"], F.when(p.startswith(parts["first"]), F.length(parts["first"]) + 1).otherwise(0).cast("int"),
        lambda at, part: F.when(at == 0, 0).otherwise(
            F.when(F.position(part, p, at) > 0, F.position(part, p, at) + F.length(part)).otherwise(0)).cast("int"))
    at_end = F.when(parts["last"].isNull(), p == parts["first"]).otherwise(
        p.endswith(parts["last"]) & (F.length(p) - F.length(parts["last"]) + 1 >= behind))
    return (behind > 0) & (~parts["ends"] | at_end)


def effective_rules(rules: DataFrame, agent: str) -> DataFrame:
    """Per host, our agent's group if it has one, else the ``*`` group."""
    r = rules.where(F.lower("agent").isin(agent.lower(), "*"))
    own = r.groupBy("host").agg(F.max(F.lower("agent") == agent.lower()).alias("_has_own"))
    return r.join(own, "host").where(F.when(F.col("_has_own"), F.lower("agent") == agent.lower())
                                     .otherwise(F.col("agent") == "*")).drop("_has_own")


def apply_robots(urls: DataFrame, rules: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """Urls + ``allowed`` (boolean) and ``status_code`` (-9998 when disallowed).

    Decided once per distinct (host, path). Plain prefix rules -- nearly all
    of them -- match through an equi-join on (host, path prefix): each path
    offers its prefixes at the lengths that rules of its own host have, so no
    path is paired with every rule. The wildcard rules of a host (``*`` or a
    final ``$``) come to its paths as arrays of at most about ``WILDCARDS``
    rules, and a path is tested once against each array.
    """
    eff = effective_rules(rules, agent).select(F.lower("host").alias("_h"), "allow", "pattern").where(F.col("pattern").isNotNull())
    wild = F.col("pattern").contains("*") | F.col("pattern").endswith("$")
    plain = eff.where(~wild)
    wildcard = eff.where(wild).withColumn("_parts_of", wildcard_parts(F.col("pattern")))
    u = urls.withColumn("_h", url_host(F.col(url_col))).withColumn(
        "_pq", F.regexp_extract(F.col(url_col), _PATH_QUERY_RE, 1))
    u = u.withColumn("_pq", F.when(F.col("_pq") == "", F.lit("/")).otherwise(F.col("_pq")))
    paths = u.select("_h", "_pq").distinct()
    lengths = plain.groupBy("_h").agg(F.collect_set(F.length("pattern")).alias("_lengths"))
    cands = paths.join(lengths, "_h").select("_h", "_pq", F.explode("_lengths").alias("_n")) \
        .where(F.length("_pq") >= F.col("_n")).select("_h", "_pq", F.substr("_pq", F.lit(1), F.col("_n")).alias("pattern"))
    exact = cands.join(plain, ["_h", "pattern"]).select("_h", "_pq", F.struct(F.length("pattern").alias("n"), "allow").alias("_rule"))
    parts = wildcard.groupBy("_h").agg(F.ceil(F.count(F.lit(1)) / WILDCARDS).alias("_parts"))
    arrays = wildcard.join(parts, "_h").groupBy("_h", F.pmod(F.xxhash64("pattern"), F.col("_parts")).alias("_part")).agg(
        F.collect_list(F.struct(F.length("pattern").alias("n"), "allow", F.col("_parts_of").alias("parts"))).alias("_rules"))
    best = F.array_max(F.transform(F.filter("_rules", lambda r: path_matches("_pq", r["parts"])),
                                   lambda r: F.struct(r["n"].alias("n"), r["allow"].alias("allow"))))
    loose = paths.join(arrays, "_h").select("_h", "_pq", best.alias("_rule")).where(F.col("_rule").isNotNull())
    decided = exact.unionByName(loose).groupBy("_h", "_pq").agg(F.max("_rule").getField("allow").alias("_allow"))
    out = u.join(decided, ["_h", "_pq"], "left")
    allowed = F.coalesce(F.col("_allow"), F.lit(True))
    return out.select(*urls.columns, allowed.alias("allowed"),
                      F.when(allowed, F.lit(None)).otherwise(F.lit(IGNORED_STATUS)).cast("int").alias("status_code"))
