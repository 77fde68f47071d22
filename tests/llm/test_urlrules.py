"""URL rules against brute force and SQL."""

import random
import re

from mercato.llm import urlrules
from mercato.llm.queries import ORACLE_SQL, op8_urlrules

from oracle_compare import compare, duck
from .helpers import SF


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        place = re.match(r"[^?#]*", url.split("://", 1)[1], re.S).group()
        host = place.split("/")[0]
        path = place[len(host):]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, "none"
    longest = max((len(r.host), len(r.path)) for r in fits)
    rule = next(r for r in fits if (len(r.host), len(r.path)) == longest)
    return host, path, rule.name, rule.action


def test_random_urls_and_rules(spark):
    random.seed(3)
    labels = ["a", "b", "com", "a-b", "net", "é", "A", " ", ""]
    urls = [None, "", "http://", "nope", "a://b", "http://COM/x?y#z", "x://com?q", "x://com#f/", "x://com/en/",
            "http://a..com/", "http://-.com/en/", "http://com./en/", "x://com/a\nb/c"]
    urls += ["h://" + ".".join(random.choice(labels) for _ in range(random.randint(1, 4))) + "/"
             + "/".join(random.choice(["en", "fr", "e", ""]) for _ in range(random.randint(0, 3))) for _ in range(1500)]
    urls += ["http://hot.com/en/"] * 700
    rules = [urlrules.Rule(random.choice(["block", "allow"]),
                           ".".join(random.choice(labels[:5]) for _ in range(random.randint(1, 3))),
                           random.choice(["/", "/en", "/en/fr", "/e", "", "/fr/en/"])) for _ in range(40)]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, Host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict)
           for r in urlrules.judge(df.repartition(3), rules, default="none").collect()}
    assert len(got) == len(urls)
    once = list(dict.fromkeys(rules))
    assert {i: brute(u, once) for i, u in enumerate(urls)} == got


def test_a_hot_host_is_cut_into_ranges(spark):
    df = spark.createDataFrame([(i, "http://hot.com/en/") for i in range(5000)], "page_id long, url string")
    host, path = urlrules.host_and_path(df.url)
    import pyspark.sql.functions as F
    keys = df.select(F.xxhash64("page_id").alias("salt"), host.alias("h"), path.alias("p"))
    keys = keys.withColumn("key", urlrules._sort_key(urlrules.reversed_host(F.col("h")), F.col("p"), F.col("salt")))
    assert len(urlrules.cut_points(keys, 8)) == 7


def test_query_against_sql(spark):
    con = duck(SF)
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{SF}/pages.parquet'")
    ok, message = compare(op8_urlrules(spark, SF), con, ORACLE_SQL["op8_urlrules"])
    assert ok, message


def test_edge_cases(spark):
    df = spark.createDataFrame([(None, None), (1, "x://a/"), (1, "x://a/")], "page_id long, url string")
    rules = [urlrules.Rule("block", "a", "/"), urlrules.Rule("block", "a", "/")]
    rows = urlrules.judge(df, rules).collect()
    assert sorted((r.page_id or 0, r.rule, r.verdict) for r in rows if r.page_id) == [(1, "a/", "block")] * 2
    assert [(r.host, r.path, r.rule, r.verdict) for r in rows if not r.page_id] == [("", "", None, "allow")]
    assert {r.verdict for r in urlrules.judge(df, []).collect()} == {"allow"}
    assert urlrules.judge(df.limit(0), rules).count() == 0
