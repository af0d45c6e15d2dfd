"""A forgiving HTML reader into flat arrays of elements, and the features of each element."""

from __future__ import annotations

import html
import math
import re

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their own end tag.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold main text, whatever the classifier says.
SILENT = frozenset("head script style noscript template iframe svg math textarea select option button title object audio video canvas noembed noframes datalist".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
#: An opening tag of the key ends an open element of the set, up to the nearest border.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
          "tbody": ("tbody", "thead", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th")}
BORDER = frozenset("ul ol dl table html body article section div td th".split())
ENDS_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}

GOOD = frozenset("article articlebody content post entry main story body text maincontent page hentry prose blogpost read".split())
BAD = frozenset(
    "ad ads adv advert advertisement adsense banner sponsor sponsored promo promoted promotion nav navbar navigation menu header masthead footer sidebar side aside widget rail "
    "comment comments commentlist reply replies respond discussion disqus feedback cookie cookies consent gdpr notice alert warning popup modal overlay toast "
    "newsletter subscribe subscription signup login signin register search form share sharing social related recommended recommendations more breadcrumb breadcrumbs "
    "pagination pager toolbar copyright legal disclaimer tags skip contentinfo complementary dialog hidden subscribe-box cta outbrain taboola".split())
TAGS = ("article main section div p h1 h2 h3 h4 ul ol li a span b strong em i blockquote pre table tr td nav header footer aside form label input body html figure figcaption img br").split()
#: Inline marks that go with the text around them unless their attributes say otherwise.
PLAIN = frozenset("b strong em i u s span code kbd sub sup small mark q cite abbr time var font big tt wbr br".split())
TAG_AT = {t: i for i, t in enumerate(TAGS)}
N_FEATURES = 30

TOKEN = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
OPEN = re.compile(r"</?([a-zA-Z][^\s/>]*)")


class Page:
    """Elements in document order: ``tag``, ``parent``, ``tokens`` (words of attributes), ``depth``; ``texts``: (element, text)."""

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.depth, self.tokens, self.hidden = ["#root"], [-1], [0], [frozenset()], [False]
        self.texts: list[tuple[int, str]] = []
        self._read(source)

    def _read(self, s: str) -> None:
        stack, open_tags, at, n = [0], {}, 0, len(s)
        last = {'"': s.rfind('"'), "'": s.rfind("'")}

        def pop() -> None:
            open_tags[self.tag[stack.pop()]] -= 1

        def add_text(text: str) -> None:
            if text:
                self.texts.append((stack[-1], text))

        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                add_text(s[at:])
                break
            if s.startswith("<!--", lt):
                add_text(s[at:lt])
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
                continue
            if s.startswith(("<!", "<?"), lt):
                add_text(s[at:lt])
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
                continue
            m = OPEN.match(s, lt)
            gt = s.find(">", lt) if m else -1
            if not m or gt < 0:
                if m and gt < 0:  # a tag cut off by the end of the page
                    add_text(s[at:lt])
                    break
                add_text(s[at:lt + 1])
                at = lt + 1
                continue
            add_text(s[at:lt])
            tag, closing = m.group(1).lower(), s[lt + 1] == "/"
            quote = m.end()
            while True:  # a ">" inside quotes does not end the tag
                marks = [q for q in (s.find('"', quote, gt), s.find("'", quote, gt)) if q >= 0]
                if not marks or not re.search(r"=\s*$", s[max(quote, min(marks) - 8):min(marks)]):
                    break
                mark = min(marks)
                if last[s[mark]] <= mark:
                    break
                quote = s.find(s[mark], mark + 1) + 1
                if quote > gt:
                    gt = s.find(">", quote)
                    if gt < 0:
                        gt = n
                        break
            inside, at = s[m.end():gt], gt + 1
            if closing:
                if open_tags.get(tag):
                    while self.tag[stack[-1]] != tag:
                        pop()
                    pop()
                continue
            if tag in ENDS_P and open_tags.get("p"):
                while self.tag[stack[-1]] != "p" and self.tag[stack[-1]] not in BORDER:
                    pop()
                if self.tag[stack[-1]] == "p":
                    pop()
            if tag in CLOSES:
                depth = len(stack) - 1
                while depth > 0 and any(open_tags.get(t) for t in CLOSES[tag]):
                    name = self.tag[stack[depth]]
                    if name in CLOSES[tag]:
                        while len(stack) > depth:
                            pop()
                    elif name in BORDER:
                        break
                    depth -= 1
            self.tag.append(tag)
            self.parent.append(stack[-1])
            self.depth.append(len(stack))
            self._attributes(inside)
            if tag in BLOCK:  # parts the texts before and after it, also where it is empty
                self.texts.append((len(self.tag) - 1, ""))
            elif tag == "br":
                add_text("\n")
            if tag in VOID or inside.endswith("/"):
                continue
            if tag in RAW:
                end = re.compile(f"</{tag}", re.I).search(s, at)
                close = s.find(">", end.end()) if end else -1
                self.texts.append((len(self.tag) - 1, s[at:end.start() if end else n]))
                at = n if not end or close < 0 else close + 1
                continue
            stack.append(len(self.tag) - 1)
            open_tags[tag] = open_tags.get(tag, 0) + 1

    def _attributes(self, inside: str) -> None:
        words, hidden = set(), False
        if "=" in inside or "hidden" in inside:
            for name, value in ATTR.findall(inside):
                name, value = name.lower(), value.strip("\"'")
                if name in ("class", "id", "role", "itemprop", "aria-label", "data-component", "name"):
                    words.update(TOKEN.findall(CAMEL.sub(" ", value).lower()))
                hidden |= name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "").lower()
        self.tokens.append(frozenset(words))
        self.hidden.append(hidden)

    def features(self) -> list[list[float]]:
        """A row per element: tag, attribute tokens, subtree text and link densities, depth, sibling statistics."""
        n = len(self.tag)
        own, all_text, links, marks, tags, children = [0] * n, [0] * n, [0] * n, [0] * n, [1] * n, [0] * n
        paragraphs, inputs, words = [0] * n, [0] * n, [0] * n
        for e, text in self.texts:
            if self.tag[e] not in SILENT:
                size = len(text.strip())
                own[e] += size
                words[e] += text.count(" ")
                marks[e] += text.count(",") + text.count(".") + text.count(";")
        for e in range(n - 1, -1, -1):
            all_text[e] += own[e]
            t = self.tag[e]
            if t == "a":
                links[e] = all_text[e]
            paragraphs[e] += t == "p"
            inputs[e] += t in ("input", "button", "select", "textarea", "label")
            p = self.parent[e]
            if p >= 0:
                for x in (all_text, links, marks, tags, paragraphs, inputs, words):
                    x[p] += x[e]
                children[p] += 1
        place, same, group_text = [0] * n, {}, [0] * n
        good, bad, bad_up, good_up, nav_up = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        for e in range(1, n):
            p = self.parent[e]
            place[e] = group_text[p]
            group_text[p] += 1
            same[p, self.tag[e]] = same.get((p, self.tag[e]), 0) + 1
            good[e], bad[e] = len(self.tokens[e] & GOOD), len(self.tokens[e] & BAD)
            bad_up[e] = bad_up[p] + (bad[e] > 0)
            good_up[e] = good_up[p] + (good[e] > 0 or self.tag[e] in ("article", "main"))
            nav_up[e] = nav_up[p] + (self.tag[e] in ("nav", "footer", "aside", "form", "header", "menu", "dialog"))
        total = max(all_text[0], 1)
        out = []
        for e in range(n):
            t, p = self.tag[e], max(self.parent[e], 0)
            size = max(all_text[e], 1)
            out.append([
                TAG_AT.get(t, len(TAGS)), t in ("article", "main"), t in ("nav", "footer", "aside", "form", "header", "menu", "dialog", "fieldset"), t in BLOCK,
                t[:1] == "h" and t[1:].isdigit(), t == "p", t == "a", t == "li", good[e], bad[e], bad_up[e], good_up[e], nav_up[e], self.hidden[e],
                self.depth[e], math.log1p(all_text[e]), math.log1p(own[e]), all_text[e] / total, links[e] / size, marks[e] / size, all_text[e] / tags[e], tags[e],
                children[e], place[e] / max(children[p], 1), same.get((p, t), 1) / max(children[p], 1), all_text[e] / max(all_text[p], 1), paragraphs[e], inputs[e],
                words[e] / size, len(self.tokens[e])])
        return out

    def decode(self, log_odds) -> list[bool]:
        """Which elements hold main text: the labelling of largest total log-odds in which no element is kept below one
        that is dropped. One pass up sums what each kept subtree is worth, one pass down decides."""
        n = len(self.tag)
        worth = [0.0] * n
        for e in range(n - 1, -1, -1):
            plain = self.tag[e] in PLAIN and not self.tokens[e] & BAD
            worth[e] += 1e-6 if plain else float(log_odds[e])
            if e and self.tag[e] not in SILENT and not self.hidden[e]:
                worth[self.parent[e]] += max(worth[e], 0.0)
        keep = [True] * n
        for e in range(1, n):
            keep[e] = keep[self.parent[e]] and worth[e] > 0 and self.tag[e] not in SILENT and not self.hidden[e]
        return keep

    def main_text(self, keep: list[bool]) -> str:
        """Texts of kept elements, block by block in page order; white space inside a block is one space."""
        n = len(self.tag)
        block = [0] * n
        for e in range(1, n):
            block[e] = e if self.tag[e] in BLOCK else block[self.parent[e]]
        blocks: list[list[str]] = []
        at = None
        for e, text in self.texts:
            if not text:  # a block element begins
                at = None
            if not keep[e]:
                continue
            if at != block[e]:
                blocks.append([])
                at = block[e]
            blocks[-1].append(html.unescape(text))
        lines = (" ".join("".join(b).split()) for b in blocks)
        return "\n".join(x for x in lines if x)
