import math

import xxhash

from codeweft.llm import queries, url_filter as uf


def slow_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    m = next((i for i, c in enumerate(rest) if i >= n and c in "?#"), len(rest))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n]), rest[n:m]


def slow_rule(host, path):
    fit = [r for r in queries.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    return max(fit, key=lambda r: len(r[0] + r[1]), default=None)


def slow_grams(host, path):
    if not host and not path:
        return []
    out = set()
    for mark, x in (("h", host), ("p", path)):
        x = f"^{x}$"
        for n in uf.GRAMS:
            for i in range(max(1, len(x) - n + 1)):
                h = xxhash.xxh64_intdigest(x[i : i + n].encode(), xxhash.xxh64_intdigest(mark.encode(), 42))
                out.add((h - 2**64 if h >= 2**63 else h) % uf.BUCKETS)
    return sorted(out)


def slow_model():
    rows = [(slow_grams(*slow_split(u)), y) for u, y in uf.LABELLED]
    w, b = [0.0] * uf.BUCKETS, 0.0
    for _ in range(uf.STEPS):
        miss = [y - 1 / (1 + math.exp(-(b + sum(w[j] for j in f) / math.sqrt(len(f))))) for f, y in rows]
        w = [x * (1 - uf.RATE * uf.PENALTY) for x in w]
        for (f, _), e in zip(rows, miss):
            for j in f:
                w[j] += uf.RATE * e / math.sqrt(len(f))
        b += uf.RATE * sum(miss) / len(rows)
    return w, b


URLS = [None, "", "no scheme", "http://EXAMPLE.com/en/1", "https://www.example.com/en/2?q#x", "http://sub.www.example.com/en/", "http://a.example.com/en", "https://x.net/es/3", "https://net/fr/", "http://x.net/de/1", "http://example.com", "http://example.com?x/", "ftp://q.org:80/a#b://c", "http://badcom/x", "://", "http://clicks.example.top/bonus?ref", "http://x.org/docs/guide.html", "https://WWW.Éxample.ORG/fr/9#://"]


def test_verdicts_agree_with_plain_code(spark):
    w, b = slow_model()
    pages = spark.createDataFrame([(i, u, "html", "clash") for i, u in enumerate(URLS)] + [(0, None, None, None)], "page_id bigint, url string, html string, host string")
    found = uf.verdicts(pages, queries.RULES, uf.labelled_urls(spark)).collect()
    assert len(found) == len(URLS) + 1
    for r in found:
        host, path = slow_split(URLS[r.page_id])
        rule, f = slow_rule(host, path), slow_grams(host, path)
        p = 1 / (1 + math.exp(-(b + sum(w[j] for j in f) / math.sqrt(max(1, len(f))))))
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1])
        assert abs(p - r.probability) < 1e-9
        assert r.verdict == (rule[2] if rule else "block" if p >= 0.5 else "allow")


def test_model_learns_its_table(spark):
    pages = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(uf.LABELLED)], "page_id bigint, url string")
    found = {r.page_id: r.verdict for r in uf.verdicts(pages, [], uf.labelled_urls(spark)).collect()}
    assert all(found[i] == ("block" if y else "allow") for i, (_, y) in enumerate(uf.LABELLED))


def test_plan_has_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com/")], "page_id bigint, url string")
    plan = uf.verdicts(pages, queries.RULES, uf.labelled_urls(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


def test_held_out_urls(spark):
    rows = [(i, u, y) for i, (u, y) in enumerate(uf.LABELLED)]
    right = 0
    for part in range(3):
        learn = spark.createDataFrame([(u, y) for i, u, y in rows if i % 3 != part], "url string, label int")
        held = spark.createDataFrame([(i, u) for i, u, _ in rows if i % 3 == part], "page_id bigint, url string")
        found = {r.page_id: r.verdict for r in uf.verdicts(held, [], learn).collect()}
        right += sum((found[i] == "block") == bool(y) for i, _, y in rows if i in found)
    assert right / len(rows) > 0.9 and len({u.split("/")[2] for u, _ in uf.LABELLED}) > 250


def test_no_join_without_a_key(spark):
    plan = uf.train(uf.labelled_urls(spark))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
