"""Main text of web pages: gradient-boosted trees over DOM elements and hierarchical decoding.

Each element is described by its tag, attribute words, subtree text, link and tag densities, depth and sibling
statistics; boosted trees give its log-odds to hold main text; decoding picks the best labelling of the tree in which
nothing is kept below a dropped element. Parsing, features, trees and decoding run in the task that reads the page.

Training. There are no labelled pages, so labelled ones are made: the text blocks of a bounded sample of pages
(``sample_pages``, the smallest hashes of the url) are laid out anew in random page designs whose parts are known
(article, menus, headers, footers, sidebars, notices, adverts, forms, comments, with usual and with bare markup). The
model sees densities and structure, no words of the text. Of each sampled page the first ``sample_chars`` characters give
blocks, so block lengths and marks further down a long page are not in the training; extraction reads whole pages. The
model is trained once per call on the driver from that sample;
``sample_pages`` x ``designs`` bounds the work whatever the table's size.

Defined results: null and empty pages have an empty text; pages without any main text too; repeated rows and urls are
read one by one; tags that are never closed or cut off are closed where a browser would; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.dom import SILENT, Page
from tidemark.llm.gbt import Forest, fit

FILLER = "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua."


def sample_blocks(pages: DataFrame, html_col: str, url_col: str, sample_pages: int, sample_chars: int = 20_000) -> list[str]:
    """Text blocks of a bounded sample, tags removed; only their lengths and marks matter."""
    rows = pages.select(F.substring(F.col(html_col), 1, sample_chars).alias("h"), F.xxhash64(F.col(url_col), F.col(html_col)).alias("o")).filter("h IS NOT NULL")
    lowest = [r.o for r in rows.select("o").orderBy("o").limit(sample_pages).collect()]  # hashes only: no task sends pages that are not taken
    rows = rows.filter(F.col("o").isin(lowest)).dropDuplicates(["o"])
    out = []
    for r in sorted(rows.collect(), key=lambda r: r.o):
        out += [t for t in (re.sub(r"\s+", " ", x).strip() for x in re.split(r"<[^>]*>", re.sub(r"(?s)<(script|style).*?</\1>", " ", r.h))) if len(t) > 3]
    return out or [FILLER]


def designed(blocks: list[str], rnd: random.Random) -> str:
    """A page of a random design; elements of the article carry ``data-main``."""
    pick = lambda lo, hi: (rnd.choice(blocks) * (1 + lo // 40))[:rnd.randint(lo, hi)].replace("<", " ")
    short = lambda: pick(4, 24)
    link = lambda m="": f'<a{m} href="/x">{short()}</a>'

    def named(tag: str, words: str, inner: str, bare: float = 0.3) -> str:
        """A noise part as its own element, or as a div that its attributes alone give away."""
        word = rnd.choice(words.split())
        if tag and rnd.random() < bare:
            return f"<{tag}>{inner}</{tag}>"
        how = rnd.choice(('class="{}"', 'id="{}"', 'class="{}-wrap box"', 'class="site-{}"', 'role="{}"', 'class="block {}"')).format(word)
        return f"<{rnd.choice([tag or 'div', 'div', 'section'])} {how}>{inner}</{'@'}>"

    def part(html_text: str) -> str:  # close with the tag that was opened
        tag = re.match(r"<(\w+)", html_text).group(1)
        return html_text.replace("</@>", f"</{tag}>") if "</@>" in html_text else html_text

    def menu() -> str:
        items = "".join(f"<li>{link()}</li>" for _ in range(rnd.randint(3, 9)))
        return part(named("nav", "nav navbar menu navigation breadcrumbs toolbar", rnd.choice((f"<ul>{items}</ul>", items, " | ".join(link() for _ in range(5))))))

    def header() -> str:
        return part(named("header", "header masthead banner top", rnd.choice((f"<h1>{short()}</h1>", f"<h2>{short()}</h2>", f"<p>{short()}</p>", short())) + rnd.choice(("", menu()))))

    def footer() -> str:
        return part(named("footer", "footer copyright contentinfo legal", rnd.choice((f"&copy; {pick(10, 80)}", f"<p>{pick(10, 120)}</p>", menu() + f"<p>{pick(10, 60)}</p>"))))

    def sidebar() -> str:
        body = "".join(rnd.choice((f"<li>{link()}</li>", f"<p>{pick(20, 200)}</p>", f"<h3>{short()}</h3>")) for _ in range(rnd.randint(1, 6)))
        return part(named("aside", "sidebar side widget rail related recommended promo", body))

    def notice() -> str:
        return part(named("", "cookie consent notice alert popup modal newsletter gdpr warning banner", rnd.choice((f"<p>{pick(20, 240)}</p><button>OK</button>", pick(20, 200), f"<p>{pick(20, 200)}</p>"))))

    def advert() -> str:
        return part(named("", "ad ads advert advertisement sponsored promo sponsor banner", rnd.choice((pick(8, 160), f"<p>{pick(8, 160)}</p>", link(), f"<p>{link()}</p>"))))

    def form() -> str:
        inner = f"<label>{short()}</label><input type='text'>" * rnd.randint(1, 3) + f"<button>{short()}</button>" + rnd.choice(("", f"<p>{pick(10, 80)}</p>"))
        return part(named("form", "search login signup subscribe form", inner, 0.8))

    def comments() -> str:
        one = lambda: rnd.choice(('<div class="comment"><b>{}</b><p>{}</p></div>', "<li><cite>{}</cite><p>{}</p></li>", "<article class='comment'><h4>{}</h4><p>{}</p></article>",
                                  "<div><p>{}</p><p>{}</p></div>")).format(short(), pick(20, 400))
        return part(named("", "comments comment replies discussion respond commentlist", f"<h3>{short()}</h3>" + "".join(one() for _ in range(rnd.randint(1, 5)))))

    def social() -> str:
        return part(named("", "share social sharing related more", "".join(link() for _ in range(rnd.randint(2, 5)))))

    m = " data-main"

    def main_block() -> str:
        kind = rnd.random()
        if kind < 0.62:
            text = pick(3, 60) if rnd.random() < 0.25 else pick(40, 900)
            if rnd.random() < 0.25:
                text = f"{text[:30]}<a{m} href='/y'>{short()}</a>{text[30:]}<b{m}>{short()}</b>"
            return rnd.choice((f"<p{m}>{text}</p>", f"<p{m}>{text}</p>", f"<p{m}>{text}", f"<p{m}><b{m}>{text}<br>" if rnd.random() < 0.2 else f"<p{m}>{text}</p>", f"<div{m}>{text}</div>"))
        if kind < 0.74:
            h = rnd.choice(("h2", "h3", "h4"))
            return f"<{h}{m}>{pick(4, 70)}</{h}>"
        if kind < 0.84:
            tag = rnd.choice(("ul", "ol"))
            return f"<{tag}{m}>" + "".join(f"<li{m}>{pick(4, 200)}</li>" for _ in range(rnd.randint(1, 6))) + f"</{tag}>"
        if kind < 0.92:
            return f"<blockquote{m}><p{m}>{pick(30, 300)}</p></blockquote>"
        if kind < 0.96:
            return f"<pre{m}>{pick(20, 300)}</pre>"
        return f"<table{m}>" + "".join(f"<tr{m}><td{m}>{short()}</td><td{m}>{pick(4, 60)}</td></tr>" for _ in range(rnd.randint(1, 4))) + "</table>"

    inserts = [advert, social, sidebar, notice, form, comments]
    body = [f"<h1{m}>{pick(4, 80)}</h1>"] if rnd.random() < 0.75 else []
    for _ in range(rnd.choice((0, 1, 1, 2, 3, 5, 8, 14, 25))):
        body.append(main_block())
        if rnd.random() < 0.08:
            body.append(rnd.choice(inserts)())
    if rnd.random() < 0.2:
        body = [f"<header{m}>{''.join(body[:1])}</header>"] + body[1:] if body else body
    article = "".join(body)
    opening = rnd.choice(("<article{m}>", "<article{m}>", "<main{m}>", '<div{m} class="content">', '<div{m} class="post-body entry">', '<div{m} id="main">', "<div{m}>", "<section{m}>",
                          '<main{m}><article{m} class="post">', '<div{m} id="content"><div{m} class="article-body">')).replace("{m}", m)
    article = opening + article + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))
    tops = [f() for f in rnd.sample((header, menu, advert, notice, form, sidebar, social), rnd.randint(0, 4))]
    tails = [f() for f in rnd.sample((footer, comments, sidebar, social, advert, form, notice, menu), rnd.randint(0, 4))]
    if rnd.random() < 0.6:
        tails.append(footer())
    middle = "".join(tops) + article + "".join(tails)
    if rnd.random() < 0.4:
        middle = f'<div{m} class="{rnd.choice(("wrapper", "page", "container", "row", "site"))}">' + middle + "</div>"
    return f"<html{m}><head><title>{short()}</title><script>x=1</script></head><body{m}>{middle}</body></html>"


def train(blocks: list[str], designs: int = 700, seed: int = 11) -> Forest:
    rnd = random.Random(seed)
    rows, labels, weights = [], [], []
    for _ in range(designs):
        source = designed(blocks, rnd)
        marked, page = Page(source), Page(source.replace(" data-main", ""))
        marks = _marks(source)
        assert len(marked.tag) == len(page.tag) == len(marks)
        for e, row in enumerate(page.features()):
            if e and page.tag[e] not in SILENT:
                rows.append(row)
                labels.append(marks[e])
                weights.append(1.0)
    return fit(np.array(rows, np.float64), np.array(labels, np.float64), weight=np.array(weights))


def _marks(source: str) -> list[int]:
    """Which elements of a designed page are marked, in the order of :class:`Page`."""
    seen: list[int] = [1]

    class Marked(Page):
        def _attributes(self, inside: str) -> None:
            super()._attributes(inside)
            seen.append(int("data-main" in inside))

    Marked(source)
    return seen


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sample_pages: int = 200, designs: int = 700, model: Forest | None = None,
            sample_chars: int = 20_000) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    model = model or train(sample_blocks(pages, html_col, url_col, sample_pages, sample_chars), designs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                made = [Page(s or "") for s in batch.column(2).to_pylist()]
                rows = [p.features() for p in made]
                odds = model.log_odds(np.array([r for x in rows for r in x], np.float64))
                ends = np.cumsum([len(x) for x in rows])
                texts = [p.main_text(p.decode(odds[e - len(x):e])) for p, x, e in zip(made, rows, ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
