"""Main text of web pages as the maximum-scoring run of tokens.

A page is a sequence of tags and words. Words score positive and tags negative, and one linear scan finds the contiguous
run with the greatest sum: the content region. The weights are learned from labelled pages (`labelled_pages`, written by
this module, since the tables have none): a word's by the elements that it stands in, a tag's by how often it stands
outside of articles, and how heavy tags are against words is what makes the scan find the labelled regions best.

What a word stands in is described by the tags and the class, id and role words of the elements around it, the innermost
region apart from those further out; no name excludes anything by itself. Blocks inside the region whose words are
likelier boilerplate than article under the same weights (adverts, forms, reader comments) are left out.

Character references are decoded, white space inside a block becomes one space, blocks are joined by one space.

Defined cases: null, empty or text-free html gives an empty text. Pages may be cut anywhere: an unfinished tag is no
text, unclosed elements end with their parent. Repeated rows are read each, rows without page_id or url too. Extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: A comment, a declaration, or a tag; quotes count after = alone, so that an apostrophe elsewhere is a plain character.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|<(?=/?\Z)", re.S)
ATTRIBUTE = re.compile(r"[\s\"'/](?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
# HTML's elements whose content is no text of the page, without content, and without a box of their own.
HIDDEN = set("script style textarea title template iframe noembed noframes select datalist".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that only arrange text, and so are no regions.
FLOW = INLINE | set("html body p li ul ol dl dt dd h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption table thead tbody tfoot tr td th caption br hr noscript object math svg".split())
#: Clips of a word's log odds, ridge of the regression, and candidates for the weight of tags.
CLIP, RIDGE, HEAVY = 4.0, 0.5, [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
PLAIN = ()


@dataclass
class Weights:
    """Log odds of a word by feature (`""`: always), score of a tag by name, and the weight of tags."""

    word: dict[str, float]
    tag: dict[str, float]
    heavy: float

    def odds(self, context: tuple[str, ...]) -> float:
        """Log odds of standing in an article."""
        return max(-CLIP, min(CLIP, self.word.get("", 0.0) + sum(self.word.get(f, 0.0) for f in context)))


def softplus(x: float) -> float:
    return math.log1p(math.exp(x))


def names_of(attributes: str) -> list[str]:
    if "=" not in attributes:
        return []
    return [w for m in ATTRIBUTE.finditer(attributes) for v in m.groups() if v for w in re.split(r"[\s_-]+", v.lower()) if w]


def tokens(page: str) -> Iterator[tuple[str, str, tuple[str, ...], int]]:
    """(kind, value, context, place) of each token: ("tag", name, ...) and ("text", text, ...).

    The context has a feature for the tag and each name of the innermost region ("in:") and of those around it ("of:"),
    and tells words in links, and those in lists of links.
    """
    stack: list[tuple[str, tuple[str, ...]]] = []  # open elements and, of regions, their features
    at, n, where = 0, len(page), PLAIN

    def standing() -> tuple[str, ...]:
        regions = [f for _, f in stack if f]
        out = {f"in:{f}" for f in regions[-1]} | {f"of:{f}" for r in regions[:-1] for f in r} if regions else set()
        tags = {t for t, _ in stack}
        if "a" in tags:
            out.add("link in list" if "li" in tags else "link")
        elif "li" in tags:
            out.add("list")
        return tuple(sorted(out))

    while at < n:
        m = TOKEN.search(page, at)
        begin = m.start() if m else n
        if begin > at:
            yield "text", page[at:begin], where, at
        if not m:
            return
        at = m.end()
        end, name, attributes = m[1], m[2], m[3]
        if not name:
            yield "tag", "!", where, begin
            continue
        name = name.lower()
        if end:
            if any(t == name for t, _ in stack):
                while stack.pop()[0] != name:
                    pass
                where = standing()
        elif name in HIDDEN:
            if not attributes.rstrip().endswith("/"):
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = close.end() if close else n
        elif name not in VOID:
            if name == "p" and stack and stack[-1][0] == "p":
                stack.pop()
            names = names_of(attributes) if name not in ("html", "body") else []
            features = () if name in FLOW and not names else tuple({*(f".{w}" for w in names), *([name] if name not in FLOW and name not in ("div", "section") else [])})
            stack.append((name, features))
            where = standing()
        yield "tag", name if not end else "/" + name, where, begin


def is_block(tag: str) -> bool:
    return tag.lstrip("/") not in INLINE and tag != "!"


def scores(row: list[tuple[str, str, tuple[str, ...], int]], weights: Weights) -> list[float]:
    """Words score softplus of their log odds each; tags score below zero."""
    known: dict[tuple[str, ...], float] = {}
    out = []
    for kind, value, context, _ in row:
        if kind == "tag":
            out.append(weights.heavy * weights.tag.get(value.lstrip("/"), weights.tag[""]) if value != "!" else 0.0)
        else:
            if context not in known:
                known[context] = softplus(weights.odds(context))
            out.append(known[context] * len(value.split()))
    return out


def best_run(score: list[float]) -> tuple[int, int]:
    """Start and stop of the run with the greatest sum."""
    best = total = 0.0
    first = start = stop = 0
    for k, s in enumerate(score):
        total += s
        if total <= 0:
            total, first = 0.0, k + 1
        elif total > best:
            best, start, stop = total, first, k + 1
    return start, stop


def chosen(page: str, weights: Weights, scan: bool = True) -> list[tuple[str, str, tuple[str, ...], int]]:
    """The tokens of the page's region whose words are article; all such tokens of the page without the scan."""
    row = list(tokens(page))
    start, stop = best_run(scores(row, weights)) if scan else (0, len(row))
    return [t for t in row[start:stop] if t[0] == "tag" or weights.odds(t[2]) >= 0]


def main_text(page: str | None, weights: Weights | None = None, scan: bool = True) -> str:
    out = []
    for kind, value, _, _ in chosen(page or "", weights or learned(), scan):
        out.append(html.unescape(value) if kind == "text" else " " if is_block(value) else "")
    return " ".join("".join(out).split())


# Tags and names that pages give to each kind of element. Names of `either` are found on articles as well.
KINDS = {
    "nav": (["nav", "div", "ul"], "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toc topnav subnav skip"),
    "header": (["header", "div"], "header masthead topbar banner branding logo site"),
    "footer": (["footer", "div"], "footer copyright contentinfo colophon bottom imprint"),
    "aside": (["aside", "div"], "sidebar aside widget widgets share sharing social complementary recommended rail promo teaser teasers trending"),
    "ad": (["div", "aside", "ins"], "ad ads adv advert adverts advertisement advertisements sponsor sponsored adsense outbrain"),
    "notice": (["div", "dialog", "section"], "notice notices cookie cookies consent alert popup modal gdpr newsletter subscribe signup paywall"),
    "form": (["form", "fieldset", "button", "div"], "form search login searchbox contact"),
    "comments": (["div", "section"], "comment comments respond replies reply discussion disqus commentlist"),
}
ARTICLE, EITHER, WRAPPER = "article content main post entry story body text single page".split(), "related legal tags warning work topic section info".split(), "wrapper container layout has with no site sticky fixed".split()
BARE = [
    "<div>{0}</div>", "<div><div><span>{1}</span></div><div><span>{2}</span></div></div>", "<table><tr><td><span>{1}</span></td><td><span>{2}</span></td></tr></table>",
    '<div><a href="/"><img src="i.png"></a><span>{1}</span><span>{2}</span><span>{3}</span></div>', '<div><div><h3>{1}</h3></div><div><small>{2}</small></div></div>',
    '<div><a href="/1">{1}</a> | <a href="/2">{2}</a> | <a href="/3">{3}</a></div>', "<div><span>{1}</span><br><i>{2}</i><br><i>{3}</i></div>",
]
VOCABULARY = "stone river of the light makes under old seven and it by open".split()


def labelled_pages(n: int = 400, seed: int = 7) -> list[list[tuple[str, bool]]]:
    """Pages as (html, whether it is article) fragments, from layouts with named and unnamed boilerplate all around."""
    rng = random.Random(seed)
    say = lambda a, b: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(a, b)))
    links = lambda k: "<ul>" + "".join(f'<li><a href="/{i}">{say(1, 3)}</a></li>' for i in range(k)) + "</ul>"
    para = lambda a=10, b=100: f"<p>{say(a, b)}" + rng.choice(("</p>", "", "<br></p>", f"<b>{say(1, 4)}</b></p>", f' <a href="/x">{say(1, 3)}</a> {say(2, 9)}</p>', f" <i>{say(1, 3)}</i> <span>{say(1, 5)}</span> {say(2, 9)}</p>", f" <em>{say(1, 2)}</em> <small>{say(1, 2)}</small>"))
    attribute = lambda names: rng.choice(('class="{}"', "class='{}'", 'id="{}"', 'data-x="1" class="{}"')).format(rng.choice((" ", "-")).join(names))

    def plain_parts(kind: str) -> str:
        if kind in ("nav", "header", "aside") and rng.random() < 0.6:
            return links(rng.randint(2, 8))
        if kind == "comments":
            return "".join(rng.choice(("<div>{}</div>", "<article>{}</article>", "{}")).format(para(4, 40)) for _ in range(rng.randint(1, 5)))
        return rng.choice(("{}", "<p>{}</p>", "<h2>{}</h2>", "<div><p>{}</p></div>", "<span>{}</span>")).format(say(2, 25))

    def boilerplate(kinds: list[str], bare: bool = True) -> str:
        kind = rng.choice(kinds)
        tags, names = KINDS[kind]
        if rng.random() < 0.15 and tags[0] != "div":
            return f"<{tags[0]}>{plain_parts(kind)}</{tags[0]}>"
        if bare and rng.random() < 0.3:  # nothing but its tags tells what it is
            return rng.choice(BARE).format(links(rng.randint(3, 9)), *(say(1, 4) for _ in range(4)))
        tag = rng.choice(tags)
        own = [rng.choice(names.split())] + [rng.choice(EITHER)] * (rng.random() < 0.2)
        return f"<{tag} {attribute(own)}>{plain_parts(kind)}</{tag}>"

    pages = []
    for _ in range(n):
        kinds = list(KINDS)
        page = [("<html><head><title>t</title></head><body>", False)]
        wrappers = ["<div " + attribute([rng.choice(WRAPPER + ARTICLE), rng.choice(WRAPPER), rng.choice("sidebar header footer ads nav related cookie menu x".split())]) + ">" for _ in range(rng.choice((0, 0, 1, 2)))]
        page += [(boilerplate([k for k in kinds if k != "comments"]), False) for _ in range(rng.randint(0, 5))]
        page.append(("".join(wrappers), False))
        page += [(boilerplate(["nav", "ad", "header", "notice"]), False) for _ in range(rng.randint(0, 2))]
        tag = rng.choice(("article", "main", "div", "section", "div", ""))
        named = tag and (tag in ("div", "section") and rng.random() < 0.8 or rng.random() < 0.4)
        page.append(((f"<{tag}" + (" " + attribute([rng.choice(ARTICLE)] + [rng.choice(EITHER + ARTICLE)] * (rng.random() < 0.3)) if named else "") + ">") if tag else "", False))
        title = f"<h1>{say(3, 10)}</h1>"
        page.append((f"<header>{title}<p>{say(3, 8)}</p></header>" if tag in ("article", "main") and rng.random() < 0.3 else title, True))
        for _ in range(rng.randint(1, 8)):
            part = rng.random()
            if part < 0.15:
                page.append((boilerplate(["ad", "ad", "notice", "form", "aside", "nav"], bare=False), False))
            elif part < 0.25:
                page.append((f"<section {attribute([rng.choice(EITHER), rng.choice(EITHER + ARTICLE)])}><h2>{say(1, 5)}</h2>{para()}{para()}</section>", True))
            elif part < 0.35:
                page.append((rng.choice(("<h2>{}</h2>", "<h3>{}</h3>", "<blockquote>{}</blockquote>", "<ul><li>{}</li><li>more of it</li></ul>", "<table><tr><td>{}</td></tr></table>", "<div>{}</div>")).format(say(2, 12)), True))
            page.append((para(), True))
        page.append((f"</{tag}>" if tag else "", False))
        page += [(boilerplate(["comments", "aside", "nav", "ad", "footer", "notice"]), False) for _ in range(rng.randint(0, 4))]
        page.append(("</div>" * len(wrappers), False))
        page += [(boilerplate(kinds), False) for _ in range(rng.randint(0, 3))]
        pages.append([*page, ("</body></html>", False)])
    return pages


def marked(page: list[tuple[str, bool]]) -> Iterator[tuple[tuple[str, str, tuple[str, ...], int], bool]]:
    """Tokens of a labelled page, with whether they are article."""
    ends = np.cumsum([len(f) for f, _ in page])
    for token in tokens("".join(f for f, _ in page)):
        yield token, page[int(np.searchsorted(ends, token[3], "right"))][1]


def regression(counts: dict[tuple[str, ...], list[float]], rounds: int = 25) -> dict[str, float]:
    """Weights of features by logistic regression on (words inside, words outside) of each context."""
    names = ["", *sorted({f for c in counts for f in c})]
    place = {f: k for k, f in enumerate(names)}
    x = np.zeros((len(counts), len(names)))
    x[:, 0] = 1
    for row, context in enumerate(counts):
        x[row, [place[f] for f in context]] = 1
    inside, total = np.array([c[1] for c in counts.values()]), np.array([sum(c) for c in counts.values()])
    w = np.zeros(len(names))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -20, 20)))
        h = (x * (total * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (inside - total * p) - RIDGE * w)
    return {f: round(float(v), 6) for f, v in zip(names, w, strict=True)}


@cache
def learned() -> Weights:
    """Weights from the labelled pages."""
    pages = [list(marked(p)) for p in labelled_pages()]
    words: dict[tuple[str, ...], list[float]] = defaultdict(lambda: [0.0, 0.0])
    tags = {True: Counter(), False: Counter()}
    for page in pages:
        for (kind, value, context, _), inside in page:
            if kind == "text":
                words[context][inside] += len(value.split()) ** 0.5  # long texts count, but not by every word
            elif value != "!":
                tags[inside][value.lstrip("/")] += 1
    share = {inside: sum(c.values()) for inside, c in tags.items()}
    outside = lambda t: (tags[False][t] + 1) / (tags[True][t] + 1) * share[True] / share[False]
    tag = {t: -math.log1p(outside(t)) for t in {*tags[True], *tags[False]}} | {"": -math.log(2)}
    word = regression(words)

    def right(heavy: float) -> float:
        """The share of words that the scan puts on the right side."""
        w, good, count = Weights(word, tag, heavy), 0, 0
        for page in pages:
            row = [t for t, _ in page]
            start, stop = best_run(scores(row, w))
            for k, ((kind, value, context, _), inside) in enumerate(page):
                if kind == "text":
                    n = len(value.split())
                    count += n
                    good += n * ((start <= k < stop and w.odds(context) >= 0) == inside)
        return good / count

    return Weights(word, tag, max(HEAVY, key=right))


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    weights = learned()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, weights) for h in batch["html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
