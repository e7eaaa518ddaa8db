"""Main text of web pages by maximum-scoring subsequence.

A page is a sequence of tags and words. Words score positive, tags negative, and
words in the context of boilerplate elements (navigation, footers, adverts, comments)
score below zero; one linear scan finds the contiguous run with the highest total.
Weights are learned from labelled pages, those that mark their article with one
``<article>`` element: a context's words are worth what the share of its
words inside articles says, and a tag costs what the share of its uses outside says.
Inside the best run, elements that are boilerplate by name or class are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import SLICE_ROWS, col, map_arrow, uniform

#: What follows "<" in markup; anything else is text.
_MARKUP = re.compile(r"!--|[!?]|(/?)([a-zA-Z][\w:-]*)|/|\Z")
#: The rest of a tag. Quotes count after "=" only, and nothing is tried twice, so this is linear.
_REST = re.compile(r"""((?>(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+))>""")
#: Elements whose content isn't markup, and those of them that may swallow the rest of a page that is cut off.
_RAW = frozenset("script style title textarea noscript iframe template".split())
_SWALLOW = frozenset("script style".split())
_HEAD = frozenset("base link meta script style title noscript template head".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CLOSES_P = _BLOCKS - {"body", "html"}
_INLINE = frozenset("p b i em strong u span a font small".split())
#: Elements that a block ends, as their own content has none.
_BROKEN_BY_BLOCKS = frozenset("select svg".split())
_SKIP_TAGS = frozenset("nav footer aside form button dialog menu header fieldset select svg".split())
#: Parts of names of boilerplate. A name counts if each of its parts is here or in _PLAIN_PARTS, so "cookie-notice" does and
#: "notice-of-motion" doesn't; those of _STRONG_PARTS count for any element, the others for elements that hold blocks.
_STRONG_PARTS = re.compile(r"(?:ads?|advert\w*|promo\w*|sponsor\w*|cookies?|consent|disqus|sidebar|newsletter|subscribe|breadcrumbs?|pagination|pager)", re.IGNORECASE)
_WEAK_PARTS = re.compile(
    r"(?:banner|notices?|comments?|replies|side|menus?|nav\w*|footer|header|masthead|share|sharing|social|related|recommend\w*|signup|popup|modal|overlay|widgets?|toolbar|search|login|tags?|skip)", re.IGNORECASE
)
_PLAIN_PARTS = frozenset("site page main top bottom left right box block container wrapper wrap list section area slot bar buttons button links link posts articles stories items inner outer global primary secondary unit user reader".split())
_HOLDS_BLOCKS = frozenset("div section ul ol dl table aside header footer nav form figure details center main span".split())
_ATTRS = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
_WORD = re.compile(r"\S+")
#: Worth of a word and cost of a tag where no labelled page tells.
DEFAULTS = {"word:content": 1.0, "word:skipped": -0.8, "word:inset": -0.02, "tag": -0.3, "tag:inset": -0.02}


def boilerplate_name(value: str, name: str) -> bool:
    """Whether a class or id names boilerplate, on an element of this name."""
    for token in value.split():
        parts = [x for x in re.split(r"[-_]+", token) if x]
        strong = [x for x in parts if _STRONG_PARTS.fullmatch(x)]
        weak = [x for x in parts if _WEAK_PARTS.fullmatch(x)]
        if (strong or (weak and name in _HOLDS_BLOCKS)) and all(x in strong or x in weak or x.lower() in _PLAIN_PARTS for x in parts):
            return True
    return False


def skipped(name: str, attrs: str, inside_article: bool) -> bool:
    """Whether an element is boilerplate by its name, role, class or id."""
    if name in _SKIP_TAGS and not (name == "header" and inside_article):
        return True
    if not attrs or name in ("body", "html", "article", "main"):
        return False
    for key, value in _ATTRS.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return True
        if key == "role" and value.lower() in _SKIP_ROLES:
            return True
        if key in ("class", "id") and boilerplate_name(value, name):
            return True
    return False


def tokens(html: str):
    """(kind, name, rest) in page order: "text" and its characters, "start" or "end" and a name with the attributes,
    "raw" for an element whose content was passed over. Each character is read a bounded number of times: a tag whose
    quotes don't end is read again up to its first ">" and quotes count no more; an element known to have no end isn't looked for again."""
    at, quotes, endless = 0, True, set()
    while at < len(html):
        open_ = html.find("<", at)
        if open_ < 0:
            yield "text", html[at:], ""
            return
        m = _MARKUP.match(html, open_ + 1)
        if not m:
            next_ = html.find("<", open_ + 1)
            next_ = len(html) if next_ < 0 else next_
            yield "text", html[at:next_], ""
            at = next_
            continue
        if open_ > at:
            yield "text", html[at:open_], ""
        name = m[2]
        if name is None:
            end = html.find("-->", m.end()) if m[0] == "!--" else html.find(">", open_)
            at = len(html) if end < 0 else end + (3 if m[0] == "!--" else 1)
            continue
        name, at = name.lower(), m.end()
        rest = _REST.match(html, at) if quotes else None
        if rest:
            attrs, at = rest[1], rest.end()
        else:
            quotes = False
            stop = re.compile("[<>]").search(html, at)
            end = stop.start() if stop else len(html)
            attrs, at = html[at:end], end + (1 if stop and stop[0] == ">" else 0)
        if m[1]:
            yield "end", name, ""
        elif name in _RAW and name not in endless:
            end = re.compile(rf"</{name}[^>]*(?:>|\Z)", re.IGNORECASE).search(html, at)
            if end:
                yield "raw", name, ""
                at = end.end()
            elif name in _SWALLOW:
                yield "raw", name, ""
                return
            else:
                endless.add(name)
        elif name not in _RAW:
            yield "start", name, attrs


def events(html: str):
    """(kind, name, text, skipped, inside article) in page order; kind is "tag", "break"
    (a tag that ends a block), "space" or "text". Ends that were never begun are ignored; the end
    of an element also ends what is still open in it. The end of a head may be left out."""
    stack: list[tuple[str, bool, bool]] = []
    open_: Counter = Counter()

    def close(i: int) -> None:
        for x in stack[i:]:
            open_[x[0]] -= 1
        del stack[i:]

    for token, name, rest in tokens(html):
        if stack and stack[-1][0] == "head" and (name.strip() if token == "text" else token == "start" and name not in _HEAD):
            close(len(stack) - 1)
        _, skip, inside = stack[-1] if stack else ("", False, False)
        if token == "text":
            yield "text", "", name, skip or bool(stack and stack[-1][0] == "head"), inside
            continue
        if token == "raw":
            yield "tag", name, "", True, inside
            continue
        kind = "break" if name in _BLOCKS else "space" if name == "br" else "tag"
        if token == "end":  # an end tag belongs to the element that it ends
            yield kind, name, "", skip, inside
            if open_[name]:
                i = len(stack) - 1
                while stack[i][0] != name:
                    i -= 1
                close(i)
            continue
        if name not in _VOID and not rest.rstrip().endswith("/"):
            if name in _BLOCKS and name not in ("option", "optgroup"):
                for x in _BROKEN_BY_BLOCKS:
                    if open_[x]:
                        close(next(i for i in range(len(stack)) if stack[i][0] == x))
            if name in _CLOSES_P:
                while stack and stack[-1][0] in _INLINE and any(x[0] == "p" for x in stack[-8:]):
                    close(len(stack) - 1)
            _, skip, inside = stack[-1] if stack else ("", False, False)
            stack.append((name, skip or name == "head" or skipped(name, rest, inside), inside or name in ("article", "main")))
            open_[name] += 1
        yield kind, name, "", stack[-1][1] if stack else False, stack[-1][2] if stack else False


def count_page(html: str | None, counts: dict[str, list[int]]) -> None:
    """Adds a labelled page to counts of what is inside and outside its article."""
    if not html or len(re.findall(r"<article\b", html, re.IGNORECASE)) != 1:
        return
    for kind, name, text, skip, inside in events(html):
        if kind == "text":
            if not (skip and inside):
                counts.setdefault("word:skipped" if skip else "word:content", [0, 0])[not inside] += len(_WORD.findall(text))
        elif name != "article" and not (skip and inside):
            counts.setdefault(f"tag:{name}" if not skip else "tag:skipped", [0, 0])[not inside] += 1


def weights_of(counts: dict[str, list[int]]) -> dict[str, float]:
    """Words: twice the share inside less one. Tags: minus the share outside. Both are
    smoothed by ten observations of the defaults."""
    out = dict(DEFAULTS)
    for key, (a, b) in counts.items():
        if key.startswith("word:"):
            prior = (DEFAULTS[key] + 1) / 2
            out[key] = 2 * (a + 10 * prior) / (a + b + 10) - 1
        else:
            out[key] = -(b + 10 * -DEFAULTS["tag"]) / (a + b + 10)
    # what stands inside an article but is left out of it, as an inset, says next to nothing about where the article ends
    out["word:content"] = max(out["word:content"], 0.1)
    out["word:skipped"] = min(out["word:skipped"], -0.1)
    return out


def learn_weights(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", max_pages: int = 2000) -> dict[str, float]:
    """Weights from at most about ``max_pages`` pages, chosen by a hash of the id; pages
    without a single article element teach nothing."""
    total = pages.count()
    chosen = pages.where(uniform(col(id_col)) < min(1.0, max_pages / max(1, total))).select(col(html_col).cast("string").alias("h"))

    def run(batches):
        counts: dict[str, list[int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                for html in whole.slice(at, SLICE_ROWS).column(0).to_pylist():
                    count_page(html, counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], names=["k", "a", "b"])

    # names of tags: those seen on a bounded number of pages
    got = chosen.mapInArrow(run, "k string, a bigint, b bigint").groupBy("k").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()
    return weights_of({r["k"]: [r["a"], r["b"]] for r in sorted(got, key=lambda r: r["k"])})


def extract(html: str | None, weights: dict[str, float]) -> str:
    """Blocks of the best run, joined by blank lines."""
    if not html:
        return ""
    seen = list(events(html))
    good, bad, tag = weights["word:content"], weights["word:skipped"], weights["tag"]
    best, total, start, span = 0.0, 0.0, 0, (0, -1)
    for i, (kind, name, text, skip, inside) in enumerate(seen):
        if kind == "text":
            n = len(_WORD.findall(text))
            score = n * ((weights["word:inset"] if inside else bad) if skip else good)
        elif skip:
            score = weights["tag:inset"] if inside else weights.get("tag:skipped", tag)
        else:
            score = weights.get(f"tag:{name}", tag)
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, span = total, (start, i)
    blocks, parts = [], []
    for kind, _, text, skip, _ in seen[span[0] : span[1] + 1]:
        if kind == "break":
            blocks.append("".join(parts))
            parts = []
        elif not skip:
            parts.append(" " if kind == "space" else text)
    blocks.append("".join(parts))
    clean = (" ".join(unescape(b).split()) for b in blocks)
    return "\n\n".join(b for b in clean if b)


def extract_pages(pages: DataFrame, weights: dict[str, float], *, id_col: str = "page_id", html_col: str = "html", keep: list[str] | None = None) -> DataFrame:
    """The kept columns (the id by default) and main_text, empty if there is none.

    Null and empty pages have empty text; pages cut off anywhere are read as far as they
    go. Of several best runs the first is taken. Repeated rows get equal results; an empty
    table gives no rows.
    """
    shared = pages.sparkSession.sparkContext.broadcast(dict(weights))

    def make():
        known = shared.value

        def step(texts):
            return [pa.array([extract(h, known) for h in texts.to_pylist()], pa.string())]

        return step

    return map_arrow(pages, [col(html_col).cast("string")], keep or [id_col], [("main_text", T.StringType())], make)
