"""Main text against a plain twin of the class deduction, and layouts whose unwanted part is longer than the article."""

import random
import re
from collections import defaultdict

import pytest

from tessera.llm import html, queries


def twin(pages):
    """Texts of (host, page) by vectors held whole: per host a dict of token to {page: count}."""
    hosts = defaultdict(list)
    for i, (host, page) in enumerate(pages):
        hosts[host].append((i, page or ""))
    kept, pool = {}, defaultdict(lambda: [0, 0, 0])
    for host, rows in hosts.items():
        seen, n = {}, 0
        for i, page in rows:
            tokens = html.page_tokens(*html.parse(page))
            n += len(tokens) > 1
            for k, (is_text, count, place, chars, links, parent, tag, label) in tokens.items() if len(tokens) > 1 else ():
                s = seen.setdefault(k, {"is_text": is_text, "tag": tag, "vector": {}, "place": 0, "chars": 0, "links": 0, "parent": parent, "label": 0})
                s["vector"][i] = count
                s["label"] = max(s["label"], label)
                for name, v in (("place", place), ("chars", chars), ("links", links)):
                    s[name] += v
        kept[host] = n, {k: s for k, s in seen.items() if 2 * len(s["vector"]) >= n and (k == 0 or not s["is_text"] or len(s["vector"]) > 1)}
        for k, s in kept[host][1].items():
            if not s["is_text"]:
                for at, v in enumerate((s["chars"], s["links"], len(s["vector"]))):
                    pool[k][at] += v
    out = {}
    for host, rows in hosts.items():
        (n, seen), classes, tokens = kept[host], {}, []
        for k, s in sorted(seen.items(), key=lambda x: html._signed(x[0])):
            chars, links, support = pool.get(k, (0, 0, 1))
            same = classes.setdefault(tuple(sorted(s["vector"].items())), len(classes))
            row = {c: s[c] for c in ("is_text", "tag", "place", "chars", "links", "label")}
            tokens.append(row | {"token": html._signed(k), "support": len(s["vector"]), "total": sum(s["vector"].values()), "v1": same, "v2": 0, "parent": html._signed(s["parent"]), "pool_chars": chars / support, "pool_links": links / support})
        template = html.Template(n, tokens) if n else None
        out |= {i: html.main_text(html.parse(page)[0], template) for i, page in rows}
    return [out[i] for i in range(len(pages))]


LAYOUTS = {
    "post beside comments": "<div class='post'>{0}</div><div class='comments'>{1}</div>",
    "content beside sidebar": "<div id='content'>{0}</div><div id='sidebar'>{1}</div>",
    "form inside": "<article>{0}<form>{1}</form></article>",
    "newsletter inside": "<article>{0}<div class='newsletter'>{1}</div></article>",
    "share list inside": "<article>{0}<ul class='share-list'><li>{1}</li></ul></article>",
    "cookie bar above": "<div class='cookie-bar'>{1}</div><div>{0}</div>",
    "related links below": "<article>{0}</article><section class='related'>{1}</section>",
    "comments inside": "<article>{0}<section class='comments'>{1}</section></article>",
    "comments beside": "<article>{0}</article><div id='comments'>{1}</div>",
    "one article in a named wrapper": "<div class='sidebar-right'><article>{0}</article><div class='comments'>{1}</div></div><div>{2}</div>",
}


def made(seed=1, pages=12):
    r = random.Random(seed)
    words = lambda n: " ".join("".join(r.choice("abcdefghijklmn") for _ in range(r.randint(2, 8))) for _ in range(max(n, 1)))
    for name, layout in LAYOUTS.items():
        for times in (0.5, 2, 10):
            for _ in range(pages):
                n = r.randint(20, 40)
                article, part = ([words(int(n * f) // k + 1) for _ in range(k)] for f, k in ((1, r.randint(1, 3)), (times, r.randint(1, 3))))
                inside = layout.format(*("".join(f"<p>{p}</p>" for p in x) for x in (article, part)), words(3))
                yield f"{re.sub(' ', '-', name)}.{times}", f"<html><head><title>t</title></head><body><nav>Home</nav>{inside}<footer>all rights</footer></body></html>", " ".join(article)


def test_named_parts_never_win_alone():
    hosts = defaultdict(list)
    for host, page, text in made():
        hosts[host].append((page, text))
    for host, rows in hosts.items():
        assert twin([(host, page) for page, _ in rows]) == [text for _, text in rows], host
    for host, page, text in made(2, 1):  # a host of one page
        assert twin([(host, page)]) == [text], host


def test_named_parts_never_win_among_hosts(spark):
    rows = list(made(3))
    pages = spark.createDataFrame([(i, f"http://{host}/p", page) for i, (host, page, _) in enumerate(rows)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages.repartition(3)).collect()}
    assert [got[i] for i in range(len(rows))] == [text for _, _, text in rows]


def test_pages_of_named_parts_alone_keep_their_text():
    page = "<body><div class='notice'><p>All there is</p></div></body>"
    assert html.main_text(html.parse(page)[0], None) == "All there is"


def test_long_pages_are_whole(spark):
    word = "lorem ipsum " * 100_000
    rows = [(1, "http://a.example/", f"<article><p>{word}</p><form>{word}{word}</form></article>"), (2, None, "<p>x" * 50_000), (3, "http://a.example/", None)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == word.strip() and got[2] == " ".join(["x"] * 50_000) and got[3] == ""


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_html_query_equals_twin(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").orderBy("page_id").collect()
    hosts = [re.match(html.HOST, r.url or "") for r in rows]
    plain = twin([(m[1].lower() if m else "", r.html) for m, r in zip(hosts, rows, strict=True)])
    got = {r.page_id: (r.text, r.n_chars) for r in queries.QUERIES["op5_html"](spark, f"/root/testdata/{sf}").collect()}
    assert [got[r.page_id] for r in rows] == [(t, len(t)) for t in plain]
