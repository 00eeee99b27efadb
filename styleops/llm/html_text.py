"""Main text of web pages by a style tree merged from the pages of each site."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from styleops.llm.common import narrow, small_batches, written

#: Weight of presentation against content falls with this base to the power of the number of styles.
GAMMA = 0.9
#: Branches and texts of lower importance are noise.
LEAST = 0.6
#: A branch is removed only if so large a share of its texts is noise too.
MOSTLY = 0.9
#: A text below this, on nearly all pages of a host, is noise in any branch outside the article.
NEARLY_ALL = 0.1
#: A host's own tree and that of all hosts are weighed by the host's pages and this number.
PRIOR_PAGES = 8
#: Noisy texts, or hosts, that may be broadcast; more of them are joined by host in a shuffle.
BROADCAST_TEXTS = 200_000
#: Name of the tree merged from all hosts; no host is called so.
ALL_HOSTS = "*"

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav noscript ol optgroup option p pre search section summary table tbody td "
    "template textarea tfoot th thead title tr ul".split()
)
#: Elements that never hold the main text.
NEVER = frozenset(
    "head title script style noscript template nav header footer aside form button select textarea input iframe object svg canvas menu dialog".split()
)
#: Blocks of text that are judged with the container they stand in, not as branches of their own.
TEXT_LEVEL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote address figcaption caption td th tr tbody thead tfoot option hr summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements of the main text; their own names and those of elements around them say nothing about them.
MAIN = frozenset({"article", "main"})
WHOLE = MAIN | {"html", "body"}
ENDS_PARAGRAPH = BLOCK - {"body", "html"}
#: Words in a class, id or role that name what is no part of an article.
NOISE_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer footer header menu modal nav navbar "
    "navigation newsletter notice notices popup promo promotion related replies reviews share sharing sidebar signup social sponsor sponsored subscribe toolbar "
    "widget".split()
)
#: Names of states of a page, such as has-sidebar or comments-open, which name no part.
_STATE = re.compile(r"(?:has|with|without|no|is)[-_].*|.*[-_](?:open|closed|enabled|disabled)", re.IGNORECASE)
_SPLIT = re.compile(r"[^a-zA-Z]+")


class _Open:
    """An open element: its tag, the path of the nearest container, and what is said about the text in it."""

    __slots__ = ("tag", "path", "never", "headed", "named", "main", "heading", "node")

    def __init__(self, tag: str, path: str = "", above: _Open | None = None, node: bool = False):
        self.tag, self.path, self.node = tag, path, node
        self.never = above is not None and above.never
        self.headed = above is not None and above.headed  # in the header of an article
        self.main = above is not None and above.main
        self.heading = above is not None and above.heading
        self.named: tuple[int, ...] = above.named if above is not None else ()


class Block:
    """A block of text with the path of its container; ``kept`` tells that only a whole branch may take it along."""

    __slots__ = ("path", "text", "noise", "kept", "named")

    def __init__(self, path: str, text: str, noise: bool, kept: bool, named: tuple[int, ...]):
        self.path, self.text, self.noise, self.kept, self.named = path, text, noise, kept, named


class Tree(HTMLParser):
    """The blocks of text of a page and the child sequences of its containers.

    An element of ``NEVER`` is noise, but the headings of a ``header`` inside an article are its title. So is an element named by
    ``NOISE_WORDS``, unless an article stands in it or the page has no other text.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open = [_Open("")]
        self.spared: set[int] = set()  # numbers of elements named as noise
        self.named = 0
        self.text: list[str] = []
        self.blocks: list[Block] = []
        self.sequences: list[list[str]] = [[]]
        self.finished: list[tuple[str, tuple[str, ...]]] = []

    def flush(self) -> None:
        if text := " ".join("".join(self.text).split()):
            top = self.open[-1]
            self.blocks.append(Block(top.path, text, top.never or (top.headed and not top.heading), top.main or top.heading, top.named))
        self.text = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK or tag in NEVER:
            self.flush()
        elif tag == "br":
            self.text.append(" ")
        if tag in ENDS_PARAGRAPH:
            self._close_within("p", {"article", "section", "div", "td", "li", "body", "main", "blockquote"})
        if tag == "li":
            self._close_within("li", {"ul", "ol", "menu"})
        if tag in VOID:
            return
        top = self.open[-1]
        if tag not in BLOCK and tag not in NEVER:
            self.open.append(_Open(tag, top.path, top))
            return
        style = ".".join([tag, *sorted(re.sub(r"\d+", "", v) for k, v in attrs if k == "class" and v)])
        self.sequences[-1].append(style)
        node = tag not in TEXT_LEVEL
        if node:
            self.sequences.append([])
        made = _Open(tag, f"{top.path}/{style}" if node else top.path, top, node)
        if tag == "header" and top.main:
            made.headed = True
        elif tag in NEVER:
            made.never = True
        made.main |= tag in MAIN
        made.heading |= tag in HEADINGS
        if tag in MAIN and not made.never:
            self.spared.update(top.named)
        elif tag not in WHOLE and _names_noise(attrs):
            made.named = (*top.named, self.named)
            self.named += 1
        self.open.append(made)

    def _close_within(self, tag: str, stop: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                while len(self.open) > k:
                    self._pop()
                return
            if self.open[k].tag in stop:
                return

    def _pop(self) -> None:
        top = self.open[-1]
        if top.tag in BLOCK or top.tag in NEVER:
            self.flush()
        self.open.pop()
        if top.node:
            self.finished.append((top.path, tuple(self.sequences.pop())))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if any(x.tag == tag for x in self.open[1:]):
            while self.open[-1].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data: str) -> None:
        self.text.append(data)

    def done(self, html: str) -> Tree:
        self.feed(html)
        self.close()
        while len(self.open) > 1:
            self._pop()
        self.flush()
        rest = [b for b in self.blocks if not b.noise]
        if rest and all(any(k not in self.spared for k in b.named) for b in rest):
            self.spared.update(set.intersection(*(set(b.named) for b in rest)))  # these hold all the text there is
        for block in rest:
            block.noise = any(k not in self.spared for k in block.named)
        return self


def _names_noise(attrs: list) -> bool:
    """Whether a class, id or role names a part that is no article."""
    names = [n for k, v in attrs if k in ("class", "id", "role") and v for n in v.split() if not _STATE.fullmatch(n)]
    return any(w.lower() in NOISE_WORDS for n in names for w in _SPLIT.split(n))


def tree_of(html: str) -> Tree:
    return Tree().done(html)


def host_column(url: str = "url") -> Column:
    return F.lower(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("")))


def _digest(*parts: str) -> str:
    return base64.b64encode(hashlib.blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=12).digest()).decode()


def text_key(path: str, text: str) -> str:
    """The digest of a text in the containers of one path."""
    return _digest(path, text)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many different pages of a batch show each feature of each container of their site's tree.

    Kind ``p``: the page has the container; ``s``: the sequence of its children; ``t`` and ``k``: a text in it, ``k`` one that only a whole branch may
    take along (in an article, or a heading).
    """
    for rows in batches:
        counts: Counter = Counter()
        for hosts, html in zip(rows["hosts"], rows["html"], strict=True):
            tree, own = tree_of(html), set()
            for path, sequence in tree.finished:
                own.add((path, "s", _digest(*sequence)))
                own.add((path, "p", ""))
            for block in tree.blocks:
                if not block.noise:
                    own.add((block.path, "k" if block.kept else "t", text_key(block.path, block.text)))
            for node, kind, key in own:
                for host in (*hosts, ALL_HOSTS):
                    counts[host, node, kind, key] += 1
        made = [(*k, n) for k, n in counts.items()]
        yield pd.DataFrame(made, columns=["host", "path", "kind", "feature", "pages"])


def features(pages: DataFrame) -> DataFrame:
    """``host, path, kind, feature, n``: on how many different pages of a host, and of all hosts, a feature is.

    A page that stands in the table many times counts once for each host, and once for all hosts. Of its copies one is
    shuffled; else only counts are, summed within batches first. The texts that are on one page only are one row of kind ``u`` for
    each container, ``n`` being their number; texts of a host that has no other page are told one by one.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(host_column().alias("host"), html.alias("html"), F.unhex(F.sha2(html, 256)).alias("page"))
    once = keyed.groupBy("page").agg(F.first("html").alias("html"), F.collect_set("host").alias("hosts")).select("hosts", "html")
    counted = once.mapInPandas(_features, "host string, path string, kind string, feature string, pages long")
    counts = counted.groupBy("host", "path", "kind", "feature").agg(F.sum("pages").alias("n"))
    lone = keyed.select("host", "page").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    lone = written(narrow(lone.select("host", F.lit(True).alias("lone"))), "hosts-of-one-page")
    counts = counts.join(F.broadcast(lone) if lone.count() <= BROADCAST_TEXTS else lone, "host", "left")
    single = F.col("kind").isin("t", "k") & (F.col("n") == 1) & F.col("lone").isNull()
    kind, feature = F.when(single, "u").otherwise(F.col("kind")), F.when(single, "").otherwise(F.col("feature"))
    return counts.groupBy("host", "path", kind.alias("kind"), feature.alias("feature")).agg(F.sum("n").alias("n"))


def importance(counts: DataFrame) -> DataFrame:
    """``host, path, pages, composite, texts`` for every container of every site's tree and of the tree of all hosts.

    Presentation: the entropy, to the base of the number of pages, of the child sequences a container has.
    Content: one minus the mean over its texts of log(pages with the text) to the same base; a text that is on every page
    counts 0, one that is on one page 1. They are joined with weights 1 - gamma^l and gamma^l, l being the number of
    sequences; a branch is never less important than its texts. A tree of one page says nothing (null).
    """
    log_sum = F.sum(F.when(F.col("kind") == "u", 0.0).otherwise(F.col("n") * F.log("n")))
    text = F.col("kind").isin("t", "k", "u")
    kinds = counts.groupBy("host", "path", F.when(text, "t").otherwise(F.col("kind")).alias("kind")).agg(
        F.sum("n").alias("total"), log_sum.alias("logs"), F.count(F.lit(1)).alias("different")
    )
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    nodes = kinds.groupBy("host", "path").agg(
        of("p", "total").alias("pages"),
        of("s", "total").alias("shown"), of("s", "logs").alias("s_logs"), of("s", "different").alias("styles"),
        of("t", "total").alias("texts"), of("t", "logs").alias("t_logs"),
    )
    base = F.log("pages")
    presentation = (F.log("shown") - F.col("s_logs") / F.col("shown")) / base
    content = F.when(F.col("texts") > 0, 1 - F.col("t_logs") / F.col("texts") / base).otherwise(0.0)
    weight = F.pow(F.lit(GAMMA), F.col("styles"))
    composite = F.greatest(content, (1 - weight) * F.least(presentation, F.lit(1.0)) + weight * content)
    return nodes.select("host", "path", "pages", F.when(F.col("pages") > 1, composite).alias("composite"), "texts")


def weighed(own: Column, pooled: Column, pages: Column) -> Column:
    """The importance by a host's own tree and by that of all hosts; the more pages the host has, the more its own counts."""
    return (F.coalesce(own, F.lit(0.0)) * F.when(own.isNull(), 0).otherwise(pages) + F.coalesce(pooled, F.lit(1.0)) * PRIOR_PAGES) / (
        F.when(own.isNull(), 0).otherwise(pages) + PRIOR_PAGES
    )


def noisy_texts(counts: DataFrame, nodes: DataFrame, least: float = LEAST) -> DataFrame:
    """``host, feature``: the texts to be removed from the pages of a host.

    A text counts one minus log(pages with it) to the base of the pages with its container, so one that is on a single page
    counts 1 and is never removed. It is noise if that is below ``least``. Removed are the noisy texts of a branch whose importance is
    below ``least`` and whose texts are noise to ``MOSTLY``; an article itself is no such branch. Outside the article, a noisy
    text that nearly all pages of the host have goes as well, if it is no heading.
    """
    pooled_nodes = nodes.filter(F.col("host") == ALL_HOSTS).select("path", F.col("pages").alias("all_pages"), F.col("composite").alias("pooled"))
    judged = nodes.filter(F.col("host") != ALL_HOSTS).join(pooled_nodes, "path", "left")
    judged = judged.withColumn("importance", weighed(F.col("composite"), F.col("pooled"), F.col("pages")))
    # a text that is on one page of all hosts can't be noise; one on one page of its host only counts 1 by its own tree
    texts = counts.filter(F.col("kind").isin("t", "k"))
    everywhere = texts.filter(F.col("host") == ALL_HOSTS).select("path", "feature", F.col("n").alias("all_n"))
    texts = texts.filter(F.col("host") != ALL_HOSTS).join(everywhere, ["path", "feature"]).join(judged, ["host", "path"])
    own = F.when(F.col("pages") > 1, 1 - F.log("n") / F.log("pages"))
    shared = 1 - F.log("all_n") / F.log(F.greatest("all_pages", F.lit(2)))
    texts = texts.select(
        "host", "path", "feature", "kind", "n", "texts", "importance", own.alias("own"),
        weighed(own, shared, F.col("pages")).alias("worth"),
    ).filter(F.col("worth") < least)
    texts = written(narrow(texts), "noisy-texts")
    share = texts.groupBy("host", "path").agg((F.sum("n") / F.max("texts")).alias("noise"))
    last = F.element_at(F.split("path", "/"), -1)
    article = F.split(last, r"\.")[0].isin(*MAIN)
    branch = (F.col("importance") < least) & (F.col("noise") >= MOSTLY) & ~article
    alone = (F.col("kind") == "t") & (F.col("own") < NEARLY_ALL)
    return texts.join(share, ["host", "path"]).filter(branch | alone).select("host", "feature")


def main_text(html: str, noisy: frozenset[str]) -> str:
    """The blocks of a page that are no noise, one on each line."""
    blocks = [b for b in tree_of(html).blocks if not b.noise]
    return "\n".join(b.text for b in blocks if not noisy or text_key(b.path, b.text) not in noisy)


def extract(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``page_id, url, html``.

    The pages of a host are merged into a style tree of their containers; from branches of low importance the texts that come again
    are removed (``noisy_texts``), and so are elements that never hold an article or are named as something else (``Tree``). The fewer
    pages a host has, the more the tree of all hosts counts. A text that is on one page of a host only stays, and so does, in a branch
    that is kept, a repeated one of the article. Of a ``header`` in an article the headings stay.

    Null or empty html gives an empty text; a url without host counts as the host with an empty name; ids may be null or repeat; a very
    long page is one row like any other; an empty table gives an empty result; other columns are not read.
    """
    small_batches(pages.sparkSession)
    base = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    counts = written(narrow(features(base)), "style-features")
    nodes = written(narrow(importance(counts)), "style-trees")
    noise = written(narrow(noisy_texts(counts, nodes, least)), "removed-texts")
    per_host = noise.groupBy("host").agg(F.sort_array(F.collect_set("feature")).alias("noisy"))

    @F.pandas_udf("string")
    def text(html: pd.Series, noisy: pd.Series) -> pd.Series:
        return pd.Series([main_text(h, frozenset([] if n is None else n)) for h, n in zip(html, noisy, strict=True)])

    fits = noise.count() <= BROADCAST_TEXTS
    joined = base.withColumn("host", host_column()).join(F.broadcast(per_host) if fits else per_host, "host", "left")
    return joined.select("page_id", "url", text("html", "noisy").alias("text")).withColumn("n_chars", F.length("text").cast("long"))
