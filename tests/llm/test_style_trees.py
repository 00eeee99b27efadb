"""Main text of pages: what a host's own style tree, the tree of all hosts and names decide, against brute force."""

import math
import random
from collections import Counter

from styleops.llm import html_text
from styleops.llm.common import table


def page_rows(spark, rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")


def prose(rng, words=20):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(words))


def test_articles_and_headings_stay(spark):
    """Repeated short texts of articles, repeated headings and a text on one page stay, on hosts of any size."""
    rng = random.Random(9)
    for n in (1, 2, 7, 8, 40):
        rows, want = [], []
        for k in range(n):
            own = prose(rng)
            parts = ["Yes."] if k % 4 == 3 else ["Yes.", own]
            rows.append(("http://yes.example/", "<body><article>" + "".join(f"<p>{p}</p>" for p in parts) + "</article>"))
            want.append("\n".join(parts))
            rows.append(("http://head.example/", f"<body><article><header><h1>Title {k}</h1><span>menu</span></header><h2>Summary</h2><p>{own}</p></article>"))
            want.append(f"Title {k}\nSummary\n{own}")
            rows.append(("http://plain.example/", f"<body><div class=c><h2>Summary</h2><p>{own}</p><p>{prose(rng)}</p></div>"))
            want.append("Summary\n" + rows[-1][1].split("</h2><p>")[1].replace("</p><p>", "\n").removesuffix("</p></div>"))
        got = html_text.extract(page_rows(spark, rows)).collect()
        assert [r.text for r in sorted(got, key=lambda r: r.page_id)] == want


def test_reader_comments_go():
    for comments in ("<div id=comments>", "<div class=reader-reviews>", "<section class='post-comments'>", "<ul role='comment'>"):
        words = "Reader words that are many more than the article has, said at length by several people who read it."
        for start, end in (("<article>", "</article>"), ("<div><p>", "</div>"), ("<main><div>", "</div></main>")):
            page = f"<body>{start}Eight words make the article of this page.{end}{comments}<p>{words}</p>"
            assert html_text.main_text(page, frozenset()) == "Eight words make the article of this page."


def test_a_line_of_all_pages_goes_on_hosts_of_any_size(spark):
    rng = random.Random(10)
    rows = [("http://big.example/", f"<body><p>Read more here</p><div class=c><p>{prose(rng)}</p><p>{prose(rng)}</p></div>") for _ in range(60)]
    rows += [(f"http://s{k}.example/", f"<body><p>Read more here</p><div class=c><p>{prose(rng)}</p></div>") for k in (1, 2, 2, 3, 3, 3, *[7] * 7, *[8] * 8)]
    got = html_text.extract(page_rows(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.text.split("\n") == rows[r.page_id][1].split("class=c><p>")[1].removesuffix("</p></div>").split("</p><p>")


def brute_importance(rows):
    """Composite importance of each container of each host, from the definition, page by page."""
    hosts = {}
    for host, html in {(url.split("/")[2], html) for url, html in rows}:
        hosts.setdefault(host, []).append(html_text.tree_of(html))
    hosts[html_text.ALL_HOSTS] = [html_text.tree_of(h) for h in {h for _, h in rows}]
    out = {}
    for host, trees in hosts.items():
        for path in {p for t in trees for p, _ in t.finished}:
            have = [t for t in trees if any(p == path for p, _ in t.finished)]
            sequences = Counter(s for t in have for s in {s for p, s in t.finished if p == path})
            texts = Counter(b for t in have for b in {(b.text, b.kept) for b in t.blocks if b.path == path and not b.noise})
            n = len(have)
            if n < 2:
                out[host, path] = (n, None)
                continue
            shown = sum(sequences.values())
            presentation = min(1.0, -sum(c / shown * math.log(c / shown, n) for c in sequences.values()))
            content = sum(c * (1 - math.log(c, n)) for c in texts.values()) / sum(texts.values()) if texts else 0.0
            weight = html_text.GAMMA ** len(sequences)
            out[host, path] = (n, max(content, (1 - weight) * presentation + weight * content))
    return out


def test_importance_equals_brute_force(spark, sf):
    rng = random.Random(12)
    rows = []
    for _ in range(30):
        host = rng.choice(["http://a.example/", "http://b.example/", "http://c.example/"])
        boxes = "".join(f"<div class=x{rng.randrange(3)}>{rng.choice(['One', 'Two', prose(rng, 2)])}<p>{prose(rng, 2)}</div>" for _ in range(rng.randrange(4)))
        rows.append((host, f"<body><ul><li>Home<li>News</ul>{boxes}<article><p>{prose(rng)}</article>"))
    rows += rows[:6] + [("http://d.example/", rows[0][1])]
    rows += [(r.url, r.html) for r in table(spark, sf, "pages").collect()]
    nodes = html_text.importance(html_text.features(page_rows(spark, rows)))
    got = {(r.host, r.path): (r.pages, r.composite) for r in nodes.collect()}
    want = brute_importance(rows)
    assert {k for k, v in got.items() if v[0]} == want.keys()
    for key, (n, value) in want.items():
        assert got[key][0] == n and (value is None) == (got[key][1] is None) and (value is None or abs(got[key][1] - value) < 1e-9), key


def test_the_tree_decides_where_names_say_nothing(spark):
    """No name and no element tells the menu, the promise and the text apart; importance does."""
    rng = random.Random(14)
    rows = []
    for _ in range(24):
        menu = "".join(f"<div class=q>{w}</div>" for w in ("Start", "Shop", "Contact"))
        text = f"<div class=b><p>{prose(rng)}</p><p>{prose(rng)}</p></div>"
        rows.append(("http://t.example/", f"<body><div class=a>{menu}</div>{text}<div class=z><p>We promise</p><p>All rights</p></div>"))
    pages = page_rows(spark, rows)
    for r in html_text.extract(pages).collect():
        assert r.text.split("\n") == rows[r.page_id][1].split("class=b><p>")[1].split("</p></div>")[0].split("</p><p>")
    nodes = {r.path.split("/")[-1]: r.composite for r in html_text.importance(html_text.features(pages)).filter("host = '*'").collect()}
    assert nodes["div.b"] > html_text.LEAST > max(nodes["div.q"], nodes["div.z"])
