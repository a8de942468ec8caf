"""Main text of web pages by text-to-tag ratios.

The standard library's parser streams events. Text is gathered in lines, one per block element;
each line has its characters and its tags. The ratios are smoothed by a Gaussian window and split
in two clusters by a threshold; the lines of the upper cluster vote for the region that holds the
main text, and all lines of that region are kept, short ones too, but those in parts that are known not
to be text: elements that never hold any, and elements whose class, id or role names such a part. If
all of the upper cluster lies in named parts, the one with most of it stays. Where no article or main element holds the vote, the
region is the deepest element with four fifths of it, and the text begins and ends with the cluster.

Null html: empty. A page without a line of text gives "". Repeated rows give repeated rows. Malformed
markup is read as the parser reads it; an element that is never closed ends with its parent. Very long
or deeply nested pages: one pass, linear but for the parser's own work. Lines whose ratio ties with the
threshold are in the upper cluster. An empty table gives an empty result. Columns other than page_id,
url and html are ignored.
"""

from __future__ import annotations

import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold main text.
NOT_TEXT = frozenset(
    "script style noscript template head title nav footer aside form button select textarea option iframe svg canvas object dialog menu audio video".split()
)
#: Words in class, id and role that name such parts.
NOT_TEXT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer comment comments disqus respond reply replies cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe "
    "signup login related recommended share sharing social widget toolbar pager pagination complementary contentinfo search masthead skip".split()
)
#: These name a page's head, but may name an article's.
HEADER_WORDS = frozenset(("header", "banner", "topbar"))
CONTAINER = frozenset("article body div main section td".split())
#: Gaussian window: reach in lines on both sides, and its width.
REACH, WIDTH = 2, 1.0


class Lines(HTMLParser):
    """Lines of a page: [text parts, tags, characters in links, container, part that is known not to be text].

    Containers and named parts are numbered as they open; above and outer have what each is in (-1:
    nothing). A part is HARD for what never holds text, or the number of an element that words name.
    """

    HARD = -2

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple] = []
        self.open: dict[str, int] = {}
        self.lines: list[list] = []
        self.kinds: list[str] = []
        self.above: list[int] = []
        self.outer: list[int] = []
        self.links, self.at, self.part = 0, -1, -1
        self.line = self.fresh()

    def fresh(self) -> list:
        return [[], 0, 0, self.at, self.part]

    def cut(self) -> None:
        if self.line[0]:
            self.lines.append(self.line)
            self.line = self.fresh()
        else:
            self.line[3], self.line[4] = self.at, self.part

    def within(self, *kinds: str) -> bool:
        return any(self.open.get(k) for k in kinds)

    def drops(self, tag: str, attrs) -> int:
        """2: never text, 1: named as what is no text, 0: neither."""
        if tag in NOT_TEXT:
            return 2
        inside = None
        if tag == "header":
            inside = self.within("article", "main")
            if not inside:
                return 2
        named = 0
        for k, v in attrs:
            if k == "hidden":
                return 2
            if k in ("class", "id", "role") and v and tag not in ("body", "html", "main"):
                words = set(re.split(r"[^a-z0-9]+", v.lower()))
                if words & HEADER_WORDS:
                    inside = self.within("article", "main") if inside is None else inside
                    named |= not inside
                named |= bool(words & NOT_TEXT_WORDS and not (words & HEADER_WORDS and inside))
        return int(named)

    def handle_starttag(self, tag, attrs) -> None:
        block = tag in BLOCK
        if block:
            self.cut()
        self.line[1] += 1
        if tag in VOID:
            return
        drop = self.drops(tag, attrs)
        self.stack.append((tag, drop, self.at, self.part))
        self.open[tag] = self.open.get(tag, 0) + 1
        self.links += tag == "a"
        if drop == 2:
            self.part = self.HARD
        elif drop and self.part != self.HARD:
            self.outer.append(self.part)
            self.part = len(self.outer) - 1
        if tag in CONTAINER:
            self.above.append(self.at)
            self.at = len(self.kinds)
            self.kinds.append(tag)
        if drop or tag in CONTAINER:
            self.cut()

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag) -> None:
        if tag in VOID or not self.open.get(tag):
            return
        changed = tag in BLOCK
        while self.stack:
            t, drop, at, part = self.stack.pop()
            self.open[t] -= 1
            changed |= t in BLOCK or drop > 0
            if drop or t in BLOCK:
                self.cut()
            self.links -= t == "a"
            self.at, self.part = at, part
            if t == tag:
                break
        if changed:
            self.cut()
        else:
            self.line[1] += 1

    def handle_data(self, data) -> None:
        self.line[0].append(data)
        if self.links:
            self.line[2] += len(data)


def smoothed(x: list[float], reach: int = REACH, width: float = WIDTH) -> list[float]:
    w = [math.exp(-((i / width) ** 2) / 2) for i in range(-reach, reach + 1)]
    out = []
    for i in range(len(x)):
        part = [(w[j + reach], x[i + j]) for j in range(-reach, reach + 1) if 0 <= i + j < len(x)]
        out.append(sum(a * b for a, b in part) / sum(a for a, _ in part))
    return out


def upper_cluster(x: list[float], rounds: int = 20) -> list[bool]:
    """Two clusters on a line: the threshold is the middle between the clusters' means, from the mean of all on."""
    if not x:
        return []
    t = sum(x) / len(x)
    for _ in range(rounds):
        low, high = [v for v in x if v < t], [v for v in x if v >= t]
        if not low or not high:
            break
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if new == t:
            break
        t = new
    return [v >= t for v in x]


def summed(weight: list[int], above: list[int]) -> list[int]:
    """Each one's weight with that of all in it; what is in another has a larger number."""
    for i in range(len(weight) - 1, -1, -1):
        if above[i] >= 0:
            weight[above[i]] += weight[i]
    return weight


def spread(on: list[bool], above: list[int]) -> list[bool]:
    """Which are chosen themselves or in a chosen one."""
    for i, up in enumerate(above):
        on[i] = on[i] or (up >= 0 and on[up])
    return on


def main_text(html: str | None) -> str:
    if not html:
        return ""
    p = Lines()
    p.feed(html)
    p.close()
    p.cut()
    lines = [(" ".join("".join(parts).split()), *rest) for parts, *rest in p.lines]
    lines = [x for x in lines if x[0]]

    def cluster(out: list[bool]) -> list[bool]:
        ratio = [0.0 if o else math.log1p(max(0, len(text) - link) / max(1, tags)) for o, (text, tags, link, _, _) in zip(out, lines)]
        return [x and not o for x, o in zip(upper_cluster(smoothed(ratio)), out)]

    # parts that words name go; but if they hold all of the upper cluster, and all articles, the one with most of it has a misleading name
    chosen = cluster([x[4] == p.HARD for x in lines])
    holds = spread([k in ("article", "main") for k in p.kinds], p.above)
    gone = [True] * len(p.outer)
    if not any(x[4] == -1 and (on or (x[3] >= 0 and holds[x[3]])) for on, x in zip(chosen, lines)):
        inside = [0] * len(p.outer)
        for on, x in zip(chosen, lines):
            if on and x[4] >= 0:
                inside[x[4]] += len(x[0])
        most = max(summed(inside, p.outer), default=0)
        if most:
            gone[inside.index(most)] = False
    # parts in a part go with it, or by their own name
    gone = spread(gone, p.outer)
    out = [x[4] == p.HARD or (x[4] >= 0 and gone[x[4]]) for x in lines]
    chosen = cluster(out)
    weight, total = [0] * len(p.kinds), 0
    for on, x in zip(chosen, lines):
        total += len(x[0]) * on
        if on and x[3] >= 0:
            weight[x[3]] += len(x[0])
    if not total:
        return " ".join(x[0] for x, o in zip(lines, out) if not o)
    summed(weight, p.above)
    # the region: the outermost articles that hold the vote, else the deepest element with most of it
    under = spread([k == "article" for k in p.kinds], p.above)
    named = [k == "article" and weight[i] > 0 and not (p.above[i] >= 0 and under[p.above[i]]) for i, k in enumerate(p.kinds)]
    region, certain = named, sum(w for w, on in zip(weight, named) if on) * 2 >= total
    if not certain:
        mains = [i for i, k in enumerate(p.kinds) if k == "main" and weight[i] * 2 >= total]
        most = max(mains or [i for i, w in enumerate(weight) if w * 10 >= total * 8] or [-1])
        region, certain = [i == most for i in range(len(p.kinds))], bool(mains)
    whole = not any(region)
    region = spread(region, p.above)
    kept = [i for i, x in enumerate(lines) if not out[i] and (whole or (x[3] >= 0 and region[x[3]]))]
    if not certain:  # without an element that says so, the text begins and ends with the cluster, headings included
        on = [i for i in kept if chosen[i]]
        kept = [i for i in kept if (on[0] <= i <= on[-1] or i == on[0] - 1) and lines[i][2] * 2 <= len(lines[i][0])]
    return " ".join(lines[i][0] for i in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page; one narrow pass, nothing is shuffled."""

    def run(batches):
        for b in batches:
            got = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.string()), pa.array(map(len, got), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
