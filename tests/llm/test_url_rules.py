import re

from casegrain.llm import url_rules

RULES = url_rules.RULES


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def rule_for(url, rules=RULES):
    host, path = host_path(url)
    fits = [(len(h + p), v == "allow", h + p, v) for v, h, p in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def node(url):
    if url is None or "://" not in url:
        return None
    query = re.match(r"[^?#]*(\?[^#]*)?", url.split("://", 1)[1])[1] or ""
    return "".join(host_path(url)) + query


def normal(url):
    if url is None or "://" not in url:
        return None
    host, path = host_path(url)
    host = re.sub(r"^(www|m|mobile)\.", "", host)
    path = re.sub(r"/(index\.html?)?$", "", path) or "/"
    query = (re.match(r"[^?#]*(?:\?([^#]*))?", url.split("://", 1)[1])[1] or "").split("&")
    kept = [p for p in query if p and not re.match(r"(utm_[a-z]+|gclid|fbclid|ref)(=|$)", p)]
    return "://" + host + path + ("?" + "&".join(kept) if kept else "")


def brute_force(pages, edges, normal_forms=True):
    """pages: (page_id, url); edges: (src, dst) URLs. Classes by repeated passes over all edges."""
    label = {}
    edges = [*edges, *((u, normal(u)) for _, u in pages if normal_forms)]
    for a, b in edges:
        if node(a) and node(b):
            label.setdefault(node(a), node(a))
            label.setdefault(node(b), node(b))
    moved = True
    while moved:
        moved = False
        for a, b in edges:
            a, b = node(a), node(b)
            if a and b and label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                moved = True
    blocked = {c for n, c in label.items() if rule_for("://" + n)[1] == "block"}
    out = {}
    for page_id, url in pages:
        rule, verdict = rule_for(url)
        verdict = verdict or ("block" if label.get(node(url)) in blocked else "allow")
        out[page_id] = (*host_path(url), rule, verdict)
    return out


def result(df):
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}


def test_whole_table(spark, data):
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rows = [tuple(r) for r in pages.select("page_id", "url").collect()]
    assert result(url_rules.judged(pages)) == brute_force(rows, [])


def link(href):
    return f'<head><link href="{href}" rel="alternate Canonical"></head>'


def refresh(url, wait="0"):
    return f"<META HTTP-EQUIV='Refresh' CONTENT='{wait}; URL={url}'>"


def test_blocks_reach_aliases_and_allows_win(spark):
    rows = [
        (1, "https://a.net/x", link("http://m.com/de/1")),          # alias of a blocked URL that is no page
        (2, "https://b.net/y", link("/z")),                         # chain: b/y - b/z - a/x
        (3, "https://b.net/z", refresh("https://a.net/x")),
        (4, "https://good.org/p", link("https://b.net/y")),         # explicit allow, though its class is blocked
        (5, "https://c.net/free", "<p>nothing</p>"),
        (6, "https://c.net/late", refresh("https://b.net/z", "5")),  # not at once: no alias
        (7, "https://www.example.org/en/12#top", None),
        (8, "HTTPS://X.EXAMPLE.ORG/es/q?u=1", ""),
        (9, "no scheme", link("https://b.net/y")),
        (10, None, link("https://b.net/y")),
        (11, "https://d.net/a/b.html?q=1#f", link("c.html")),
        (12, "http://d.net/a/c.html", link("//shop.com/de/9")),
        (13, "https://c.net/free", "<p>again</p>"),
        (14, "https://e.net", link("mailto:a@b.c")),
        (15, "https://example.org", "<link rel=canonical href=https://www.com/fr/a>"),
        (16, "ftp://a://b.org/x", ""),
        (17, "https://m.f.net/shop/?utm_source=feed&q=2&ref=x#top", link("https://x.com/de/")),
        (18, "http://www.f.net/shop/index.html?q=2", ""),
        (19, "https://f.net/shop?q=2&&gclid", ""),
        (20, "https://f.net/shop?q=3", ""),
    ]
    edges = [("https://a.net/x", "http://m.com/de/1"), ("https://b.net/y", "https://b.net/z"),
             ("https://b.net/z", "https://a.net/x"), ("https://good.org/p", "https://b.net/y"),
             ("https://d.net/a/b.html?q=1#f", "https://d.net/a/c.html"),
             ("http://d.net/a/c.html", "http://shop.com/de/9"), ("https://example.org", "https://www.com/fr/a"),
             ("https://m.f.net/shop/?utm_source=feed&q=2&ref=x#top", "https://x.com/de/")]
    pages = spark.createDataFrame(
        [(*r, "clash") for r in rows], "page_id long, url string, html string, component string")
    expected = brute_force([r[:2] for r in rows], edges)
    got = result(url_rules.judged(pages))
    assert got == expected
    assert got[17][3] == got[18][3] == got[19][3] == "block" and got[20][3] == "allow"
    assert got[2][3] == got[11][3] == "block" and got[4][3] == "allow" and got[6][3] == "allow"
    extra = spark.createDataFrame([("https://c.net/free", "https://b.net/y"), (None, "https://x.net/")], "src string, dst string")
    only = result(url_rules.judged(pages, normal_forms=False))
    assert only == brute_force([r[:2] for r in rows], edges, normal_forms=False)
    more = result(url_rules.judged(pages, redirects=extra))
    assert more == brute_force([r[:2] for r in rows], [*edges, ("https://c.net/free", "https://b.net/y")])
    assert more[5][3] == more[13][3] == "block"
    assert url_rules.judged(pages.limit(0)).count() == 0


def test_a_hub_with_many_aliases(spark):
    rows = [(i, f"https://s{i}.net/", link("https://hub.com/de/")) for i in range(3000)]
    rows += [(3000 + i, f"https://t{i}.net/", link(f"https://t{i + 1}.net/")) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = result(url_rules.judged(pages))
    assert {got[i][3] for i in range(3000)} == {"block"}
    assert {got[3000 + i][3] for i in range(60)} == {"allow"}


def test_longest_rule_wins_and_a_tie_allows(spark):
    rules = [("block", "a.net", "/xy"), ("allow", "a.net", "/xyz"), ("block", "b.a.net", "/"), ("allow", "a.net", "/.b")]
    urls = ["http://a.net/xy", "http://q.a.net/xyz1", "http://b.a.net/xyz", "http://na.net/xy", "http://b.a.net/.b"]
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(urls)], "page_id long, url string, html string")
    got = result(url_rules.judged(pages, rules))
    assert {i: g[2:] for i, g in got.items()} == {
        i: (rule_for(u, rules)[0], rule_for(u, rules)[1] or "allow") for i, u in enumerate(urls)}
