"""Wildcard patterns by literal parts, against brute force."""

import random
import re

from pyspark.sql import functions as F

from crawlframe.operators.robots import apply_robots, path_matches, wildcard_parts


def matches(pattern, path):
    ends = pattern.endswith("$")
    body = pattern[:-1] if ends else pattern
    return re.match("(?s)" + ".*".join(map(re.escape, body.split("*"))) + (r"\Z" if ends else ""), path) is not None


def test_patterns_match_like_brute_force(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("ab/.?\\E") for _ in range(rng.randrange(n)))
    rows = [("/" * rng.randrange(2) + "*".join(text(4) for _ in range(rng.randrange(1, 5))) + "$" * rng.randrange(2), "/" + text(12)) for _ in range(4000)]
    rows += [("*", "/"), ("$", "/"), ("$", ""), ("**$", "/x"), ("/*a*a$", "/a"), ("/a$", "/a"), ("/a$b", "/a$b"), ("/é*ü$", "/é\U0001f600ü"), ("*a", "b\na")]
    df = spark.createDataFrame(rows, "pattern string, path string").withColumn("parts", wildcard_parts("pattern"))
    got = df.select("pattern", "path", path_matches("path", F.col("parts")).alias("hit")).collect()
    assert len(got) == len(rows) and sum(r.hit for r in got) > 300
    assert [(r.pattern, r.path) for r in got if r.hit != matches(r.pattern, r.path)] == []


def test_longest_rule_wins_over_random_rules(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("ab/") for _ in range(rng.randrange(n)))
    rules = [(f"h{rng.randrange(6)}", rng.choice(["*", "me", "other"]), rng.random() < 0.4, "/" + rng.choice([text(4), text(3) + "*" + text(3), text(4) + "$"])) for _ in range(150)]
    urls = [(f"http://h{rng.randrange(7)}/{text(9)}",) for _ in range(400)]
    got = apply_robots(spark.createDataFrame(urls, "url string"), spark.createDataFrame(rules, "host string, agent string, allow boolean, pattern string"), "me").collect()

    def allowed(url):
        host, path = re.match("http://([^/]*)(.*)", url).groups()
        own = [r for r in rules if r[0] == host and r[1] == "me"] or [r for r in rules if r[0] == host and r[1] == "*"]
        hits = [(len(r[3]), r[2]) for r in own if matches(r[3], path)]
        return max(hits)[1] if hits else True

    assert len(got) == len(urls) and all(r.allowed == allowed(r.url) for r in got)
