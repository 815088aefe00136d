import random

from pyspark.sql import functions as F

from folioquery.llm.url_lists import host_of, judge_captures, keys_of, validity

SCHEMA = "key string, day int, action string"


def test_keys(spark):
    url = "HTTPS://me:pw@A.b.Example.com.:8080/En/page?x=1"
    row = spark.range(1).select(keys_of(F.lit(url)).alias("k"), host_of(F.lit(url)).alias("h")).first()
    assert row.h == "a.b.example.com"
    assert [(k.key, k["rank"]) for k in row.k] == [("example.com", 2), ("b.example.com", 3), ("a.b.example.com", 4), ("a.b.example.com/En", 1000)]
    for odd in (None, "", "no url", "http://", "http://localhost/x", "://a.b/c"):
        assert spark.range(1).select(F.coalesce(F.size(keys_of(F.lit(odd).cast("string"))), F.lit(0)).alias("n")).first().n == 0


def test_as_of_join_matches_brute_force(spark):
    pick = random.Random(5)
    hosts = ["a.x.com", "b.x.com", "x.com", "y.org", "deep.a.x.com"]
    keys = [*hosts, "a.x.com/p", "y.org/q"]
    entries = [(pick.choice(keys), pick.randint(0, 300), pick.choice(["block", "allow", "remove"])) for _ in range(120)]
    captures = [(i, f"http://{pick.choice(hosts)}/{pick.choice('pqr')}/{i}", pick.randint(0, 400)) for i in range(400)]
    captures += [(900, None, 3), (901, "bad", 3), (902, "http://x.com/", None), (5, *captures[5][1:])]
    odd = [(None, 1, "block"), ("x.com", None, "block"), ("x.com", 2, None), ("x.com", 3, "other")]
    got = judge_captures(
        spark.createDataFrame(captures, "page_id long, url string, fetch_day int").withColumn("key", F.lit("clash")),
        spark.createDataFrame([*entries, *odd], SCHEMA), 400,
    ).collect()
    strict = ["block", "allow", "remove"]

    def want(url, day):
        if url is None or day is None or not url.startswith("http"):
            return "none", None, None
        host, segment = url[7:].split("/")[:2]
        labels = host.split(".")
        for key in [f"{host}/{segment}", *(".".join(labels[-n:]) for n in range(len(labels), 1, -1))]:
            said = [e for e in entries if e[0] == key and e[1] <= day]
            if said:
                last = max(e[1] for e in said)
                action = min((e[2] for e in said if e[1] == last), key=strict.index)
                if action != "remove":
                    return action, key, last
        return "none", None, None

    assert len(got) == len(captures)
    for r in got:
        assert (r.decision, r["key"], r.listed_day) == want(r.url, r.fetch_day)


def test_validity_and_empty_tables(spark):
    entries = spark.createDataFrame([("k", 1, "allow"), ("k", 1, "block"), ("k", 5, "remove"), ("k", 9, "allow")], SCHEMA)
    rows = sorted(tuple(r) for r in validity(entries).collect())
    assert rows == [("k", "allow", 9, None), ("k", "block", 1, 5)]
    captures = spark.createDataFrame([(1, "http://a.b/", 3)], "page_id long, url string, fetch_day int")
    assert judge_captures(captures, entries.limit(0), 9).first().decision == "none"
    assert judge_captures(captures.limit(0), entries, 9).count() == 0
