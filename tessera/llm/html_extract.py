"""Main text of web pages by tag-path ratios.

Each block of text has a tag path from the root to its element. Per path the length and punctuation of its text are
summed and divided by the number of blocks; both ratios are smoothed over neighbouring paths in page order, fused,
and weighted by what the tags and their class or id say. Paths over a threshold are content. The content's mass of each element decides where
the text is: in article or main elements, if such hold content (the deepest with half of what the fullest holds, and each article whose
blocks have a tenth of its ratio), else in the deepest element with nearly all mass. There a block is kept if its path is content,
if it is a heading, or if it stands between content and isn't mostly links; in articles every block is kept. Scripts, menus, footers, hidden elements and
the like never are. Elements that only their class, id or role, or a form tag, makes boilerplate are kept out as well, unless they hold all article and main
elements of the page and a good part of its text, or, on pages without such, nearly all of its text: then they are wrappers.

Pages that are null, empty or without content give an empty text. Markup that is not closed, broken or unknown never
fails, and the time grows with the length of a page: a tag that is not closed ends with its parent or where the next begins. Rows are
independent and repeated rows alike; other columns pass through, but for one of the output's name, which is replaced; an empty table gives
an empty result.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.textops import sliced

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/><\"'=]*)")
#: What stands in a tag up to its end; possessive, so that nothing is read twice.
_INSIDE = re.compile(r"""(?:[^<>"']++|"[^"]*+"|'[^']*+')*+""")
_END = re.compile(r"[<>]")
#: Elements whose inside isn't markup of the page; the first four run to the end of a page where they are not closed.
_RAW = frozenset("script style textarea title noscript template svg iframe select math object canvas audio video button".split())
_RUNS_ON = frozenset("script style textarea title".split())
_CLOSED = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in _RAW}
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
#: Tags that begin and end a block of text; br ends one line of it.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li listing main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Blocks that a p, or an item of the same kind, ends when it is still open.
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}}
#: Tags that are never content; header is judged by where it stands, and form, as class names are, by what it holds.
BOILERPLATE_TAGS = frozenset("nav aside footer menu dialog head fieldset".split())
#: Words in a class, id or role that mark boilerplate.
BOILERPLATE_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|adslot|banner|sponsor\w*|promo\w*|cookie\w*|consent|gdpr|notice|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search\w*"
    r"|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|footer|foot|topbar|toolbar|comments?|commentlist|disqus|replies|reply|respond|discussion|share|sharing|social"
    r"|related|recommend\w*|pagination|pager|copyright|legal|disclaimer|skip|hidden|navigation|contentinfo|complementary|reactions?|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
#: Words that do so outside of article and main.
HEADER_WORDS = re.compile(r"(?:^|[\s_-])(?:header|masthead)(?:$|[\s_-])", re.I)
CONTENT_TAGS = frozenset(["article", "main"])
CONTENT_WORDS = re.compile(r"(?:^|[\s_-])(?:article\w*|content|main|post|entry|story|text|body)(?:$|[\s_-])", re.I)
#: Bytes of pages that are in memory at once, or one page.
PART = 1 << 23
_PUNCTUATION = re.compile(r"[.,;:!?…。、！？;]")


#: Elements that are no container of blocks.
_LEAVES = frozenset("p li td th h1 h2 h3 h4 h5 h6 blockquote pre dd dt".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _tokens(page: str):
    """(text before, tag, closing, attributes) of each tag, in page order; the tag is empty for what is no element's, and at the end."""
    at = last = 0  # the next place to look; the end of the last token
    unclosed: set[str] = set()
    while (at := page.find("<", at)) >= 0:
        begin, name = at, _NAME.match(page, at)
        if not name:
            if page.startswith(("<!", "<?"), at):
                mark = "-->" if page.startswith("<!--", at) else "]]>" if page.startswith("<![CDATA[", at) else ">"
                at = page.find(mark, at + 2)
                at = at + len(mark) if at >= 0 else len(page)
                yield page[last:begin], "", False, ""
                last = at
            else:
                at += 1  # a plain sign
            continue
        inside = _INSIDE.match(page, name.end())
        at = inside.end()
        if at < len(page) and page[at] in "\"'":  # a quote that nothing closes
            found = _END.search(page, at)
            at = found.start() if found else len(page)
        attributes = page[name.end() : at]
        at += at < len(page) and page[at] == ">"
        tag = name[2].lower()
        yield page[last:begin], tag, bool(name[1]), attributes
        if tag in _RAW and not name[1] and tag not in unclosed:
            found = _CLOSED[tag].search(page, at)
            if found:
                at = page.find(">", found.end())
                at = at + 1 if at >= 0 else len(page)
            elif tag in _RUNS_ON:
                at = len(page)
            else:
                unclosed.add(tag)
        last = at
    yield page[last:], "", False, ""


class Page:
    """The elements and the blocks of text of a page.

    Of each element: its parent, tag, path (a number for each list of labels from the root on), whether it is boilerplate for certain, and whether by its
    names only. Of each block: its element, the text, and how much of it links hold.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.path, self.bad, self.doubtful, self.prior = [-1], [""], [0], [False], [False], [1.0]
        self.paths = {(0, ""): 0}
        self.element, self.parts, self.linked, self.size = [], [], [], []
        stack, block, links, gap, number = [0], 0, 0, False, -1
        for before, tag, closing, attributes in _tokens(page):
            if before:
                if before.isspace():
                    gap = True
                else:
                    if number != block:
                        number, gap = block, False
                        self.element.append(stack[-1])
                        self.parts.append([])
                        self.linked.append(0)
                        self.size.append(0)
                    self.parts[-1] += (" ", before) if gap else (before,)
                    size, gap = len(before.strip()), False
                    self.linked[-1] += size if links else 0
                    self.size[-1] += size
            if not tag or tag == "br" or tag in ("textarea", "select", "button"):
                gap = gap or bool(tag)
            elif tag == "a":
                links = not closing
            elif tag in BLOCKS:
                block += 1
                if closing:
                    for i in range(len(stack) - 1, 0, -1):
                        if self.tag[stack[i]] == tag:
                            del stack[i:]
                            links = 0
                            break
                elif tag != "hr":
                    top = self.tag[stack[-1]]
                    if top == "p" or tag in _SAME and top in _SAME[tag]:
                        stack.pop()
                    stack.append(self._open(stack[-1], tag, attributes))

    def _open(self, parent: int, tag: str, attributes: str) -> int:
        names = " ".join((x[1] or "").strip("\"'") for x in _ATTR.findall(attributes) if x[0].lower() in ("class", "id", "role")) if attributes else ""
        hidden = bool(attributes) and bool(_HIDDEN.search(attributes))
        inside = self.prior[parent] >= _MARKED
        content = tag in CONTENT_TAGS and not _COMMENTS.search(names)
        doubtful = tag == "form"
        if names and tag not in ("body", "html"):
            if content:
                doubtful = bool(BOILERPLATE_WORDS.search(names)) and not CONTENT_WORDS.search(names) and bool(_TEASERS.search(names))
            else:
                doubtful = doubtful or bool(BOILERPLATE_WORDS.search(names)) or not inside and bool(HEADER_WORDS.search(names))
        self.parent.append(parent)
        self.tag.append(tag)
        self.path.append(self.paths.setdefault((self.path[parent], f"{tag}.{names}" if names else tag), len(self.paths)))
        self.bad.append(self.bad[parent] or hidden or tag in BOILERPLATE_TAGS or tag == "header" and not inside)
        self.doubtful.append(doubtful)
        self.prior.append(max(self.prior[parent], _MARKED if content else 2.0 if names and CONTENT_WORDS.search(names) else 1.0))
        return len(self.tag) - 1

    def sums(self, own: list) -> list:
        """For each element what it and all in it hold; own: what each holds itself."""
        out = list(own)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out

    def judge(self) -> list[bool]:
        """Whether each element is boilerplate; those in doubt are not if they wrap the page's content."""
        sizes, marked = [0] * len(self.tag), [0] * len(self.tag)
        for e, n in zip(self.element, self.size, strict=True):
            sizes[e] += 0 if self.bad[e] else n
        for i, tag in enumerate(self.tag):
            marked[i] = int(tag in CONTENT_TAGS and self.prior[i] >= _MARKED and not self.bad[i])
        sizes, marked = self.sums(sizes), self.sums(marked)
        out = list(self.bad)
        for i in range(1, len(out)):
            wraps = marked[i] == marked[0] and sizes[i] >= (0.3 if marked[0] else 0.8) * sizes[0]
            out[i] = out[i] or out[self.parent[i]] or self.doubtful[i] and not wraps
        return out


_MARKED = 4.0
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden|(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true", re.I)
_COMMENTS = re.compile(r"(?:^|[\s_-])comments?(?:$|[\s_-])", re.I)
_TEASERS = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|related|recommend\w*)(?:$|[\s_-])", re.I)
_KERNEL = np.exp(-0.5 * np.arange(-2, 3) ** 2)


def path_ratios(paths: list[int], lines: list[str], linked: list[int], prior: list[float]) -> tuple[list[float], list[bool]]:
    """The fused ratio of each block's path, and whether it is over the threshold; prior: a weight of each block (0 for boilerplate)."""
    order: dict[int, int] = {}  # of the first appearance
    at = [order.setdefault(p, len(order)) for p in paths]
    n = len(order)
    sums = lambda x: np.bincount(at, x, n)
    count, chars = np.bincount(at, minlength=n), sums([len(x) for x in lines])
    weight = np.zeros(n)
    np.maximum.at(weight, at, prior)
    mean, marks = chars / count, sums([len(_PUNCTUATION.findall(x)) for x in lines]) / count
    smooth = lambda x: np.convolve(np.pad(x, 2, mode="edge"), _KERNEL / _KERNEL.sum(), "valid")
    fused = (smooth(mean) + mean) * (1.0 + smooth(marks) + marks) * weight * np.clip(1.0 - sums(linked) / np.maximum(chars, 1.0), 0.0, 1.0)
    least = 0.1 * np.average(fused, weights=count * (fused > 0)) if (fused > 0).any() else np.inf
    return fused[at].tolist(), (fused >= least)[at].tolist()


def extract(page: str | None) -> str:
    """The main text of one page: a line for each block."""
    if not page:
        return ""
    found = Page(page)
    if not found.element:
        return ""
    lines = [" ".join(html.unescape("".join(parts)).split()) for parts in found.parts]
    bad = found.judge()
    own = found.element
    ratio, chosen = path_ratios([found.path[e] if not bad[e] else -1 - found.path[e] for e in own], lines, found.linked, [0.0 if bad[e] else found.prior[e] for e in own])
    mass, count, depth = [0.0] * len(bad), [0] * len(bad), [0] * len(bad)
    for e, r, ok in zip(own, ratio, chosen, strict=True):
        mass[e] += r if ok else 0.0
        count[e] += 1
    if not any(mass):
        return ""
    mass, count = found.sums(mass), found.sums(count)
    for i in range(1, len(depth)):
        depth[i] = depth[found.parent[i]] + 1
    marked = [i for i, tag in enumerate(found.tag) if tag in CONTENT_TAGS and found.prior[i] >= _MARKED and not bad[i] and mass[i] > 0]
    if marked:
        top = max(mass[i] for i in marked)
        root = max((i for i in marked if mass[i] >= 0.5 * top), key=depth.__getitem__)
        # whole: this element, and every article of a like ratio; of what lies around them in the others, content and headings
        whole = {root, *(i for i in marked if found.tag[i] == "article" and mass[i] * count[root] >= 0.1 * mass[root] * count[i])}
        around = {i for i in marked if found.tag[i] == "main"} | whole
    else:
        root = max((i for i in range(len(bad)) if mass[i] >= 0.9 * mass[0] and found.tag[i] not in _LEAVES), key=depth.__getitem__)
        whole, around = set(), {root}
    in_whole, in_around = [False] * len(bad), [False] * len(bad)
    for i in range(len(bad)):
        up = found.parent[i]
        in_whole[i] = i in whole or up >= 0 and in_whole[up]
        in_around[i] = i in around or up >= 0 and in_around[up]
    # blocks between content, in pages without articles
    content = [k for k, e in enumerate(own) if chosen[k] and in_around[e]]
    first, last = (content[0], content[-1]) if content and not marked else (0, -1)

    def keep(k: int) -> bool:
        e = own[k]
        if bad[e] or not in_around[e]:
            return False
        return in_whole[e] or chosen[k] or found.tag[e] in _HEADINGS or first < k < last and 2 * found.linked[k] <= found.size[k]

    return "\n".join(line for k, line in enumerate(lines) if line and keep(k))


def extract_pages(df: DataFrame, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """Adds the main text of each page; a column of that name is replaced. Only row-wise work: no shuffle."""
    kept = df.drop(text_column) if text_column != html_column else df
    names = kept.columns
    at = names.index(html_column)
    schema = T.StructType([*kept.schema.fields, T.StructField(text_column, T.StringType())])

    def run(batches):
        for batch in sliced(batches, 512, PART, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(extract, batch.column(at).to_pylist()), pa.string())], [*names, text_column])

    return kept.mapInArrow(run, schema)


def main_text(df: DataFrame) -> DataFrame:
    """op6: page_id, url, the text and its length in code points."""
    from pyspark.sql import functions as F

    return extract_pages(df.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
