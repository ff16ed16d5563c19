import random
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from vozlake.llm import hosts as ho


def plain_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in ho.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_domain(host):
    parts = host.split(".")
    if re.fullmatch(r"[0-9.:\[\]]*", host):
        return host
    k = 3 if ".".join(parts[-2:]) in ho.DOUBLE_SUFFIXES else 2
    return host if len(parts) <= k else ".".join(parts[-k:])


def plain_bounds(outcomes):
    """outcomes: host -> (n, bad)."""

    def level(children, mean_of):
        over = sum(n * (b / n - mean_of[k]) ** 2 / (mean_of[k] * (1 - mean_of[k])) - 1 for k, (n, b) in children.items() if n)
        pairs = sum(n - 1 for n, _ in children.values() if n)
        rho = min(ho.MOST_SPREAD, max(ho.LEAST_SPREAD, over / pairs)) if pairs else ho.USUAL_SPREAD
        return 1 / rho - 1, {k: (b + (1 / rho - 1) * mean_of[k]) / (n + 1 / rho - 1) for k, (n, b) in children.items()}

    suffix = lambda d: "" if re.fullmatch(r"[0-9.:\[\]]*", d) or "." not in d else d.split(".", 1)[1]
    sums = [defaultdict(lambda: (0, 0)) for _ in range(2)]
    for host, (n, b) in outcomes.items():
        d = plain_domain(host)
        for table, key in zip(sums, (d, suffix(d)), strict=True):
            table[key] = (table[key][0] + n, table[key][1] + b)
    total = [sum(x) for x in zip(*outcomes.values(), strict=True)]
    overall = (total[1] + 1) / (total[0] + 2)
    _, by_suffix = level(sums[1], {k: overall for k in sums[1]})
    _, by_domain = level(sums[0], {k: by_suffix[suffix(k)] for k in sums[0]})
    k, mean = level(outcomes, {h: by_domain[plain_domain(h)] for h in outcomes})
    return {h: mean[h] - ho.DEVIATIONS * (mean[h] * (1 - mean[h]) / (outcomes[h][0] + k + 1)) ** 0.5 for h in outcomes}


def rows():
    rng = random.Random(6)
    hosts = ["spam.example.net", "a.example.net", "Www.Good.co.uk", "bad.co.uk", "x.bad.co.uk", "example.org", "sub.example.org", "one.com", "10.0.0.1", "[::1]:80", "localhost", "é.fr"]
    pages, labels = [(0, None), (1, "no scheme/at all"), (2, "https://"), (3, "http://h?x://y/z"), (4, "ftp://EXAMPLE.org/es/"), (5, "a://notexample.org"), (6, "http://one.com/fr/" + "x" * 200_000), (None, "http://one.com/de/q")], []
    for key in range(10, 900):
        host = hosts[0] if rng.random() < 0.4 else rng.choice(hosts)
        pages.append((key, f"http{rng.choice(['', 's'])}://{host}{rng.choice(['', '/', '/es/1', '/en/1', '/en/2', '/fr/', '/de/x?y=/fr/', '#/fr/', '?a'])}"))
        if rng.random() < 0.7:
            rate = 0.85 if "spam" in host or "bad" in host else 0.05
            labels.append((key, int(rng.random() > rate), 0))
    pages.append(pages[20])
    labels += [(10, 0, 1), (11, None, None), (12, None, 1), (50_000, 1, 1), (None, 0, 0)]
    return pages, labels


def test_equals_a_plain_computation(spark):
    pages, labels = rows()
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("Host", F.lit("x")).withColumn("bad", F.lit(1)).withColumn("a.b", F.lit(1))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("host", F.lit("y"))
    bad = {}
    for key, quality, toxic in labels:
        if key is not None and (quality is not None or toxic is not None):
            bad[key] = max(bad.get(key, 0), int(quality == 0 or toxic == 1))
    outcomes = {}
    for key, host in {(k, plain_parts(u)[0]) for k, u in pages}:
        n, b = outcomes.get(host, (0, 0))
        outcomes[host] = (n + (key in bad), b + bad.get(key, 0))
    bounds = plain_bounds(outcomes)
    known = {r["host"]: r["bound"] for r in ho.reputation(ho.host_outcomes(df, ho.bad_outcomes(marks))).collect()}
    assert known.keys() == bounds.keys() and np.allclose([known[h] for h in bounds], list(bounds.values()))
    want = []
    for key, url in pages:
        host, path = plain_parts(url)
        rule, verdict = plain_rule(host, path)
        want.append((key, host, path, rule, verdict or ("block" if bounds[host] > ho.LIMIT else "allow")))
    got = list(map(tuple, ho.digest(df, marks).collect()))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {v for _, h, _, r, v in got if h == "spam.example.net" and r is None} == {"block"}
    assert ho.judge(df, ho.bad_outcomes(marks)).columns == [*df.columns, "url_verdict"]
    assert ho.digest(df.limit(0), marks).count() == 0
    assert {r.verdict for r in ho.digest(df, marks.limit(0)).where("rule is null").collect()} == {"allow"}
