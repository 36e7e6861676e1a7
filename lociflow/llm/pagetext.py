"""Main text of web pages, with site template removal by subtree hashes."""

from __future__ import annotations

import html as entities
import json
import re
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, read

#: A subtree is template where more of its host's distinct pages hold its texts than both of these.
LEAST_PAGES, SHARE = 10, 0.05
#: The same for its shape, of which the texts may differ; and the largest part of those pages' characters that a template's shape holds.
SHAPE_SHARE, THIN = 0.5, 0.25

#: What a browser reads as text up to the end tag and shows nowhere in the page's flow, or as a control.
_RAW = frozenset("script style template textarea title iframe noembed noframes xmp".split())
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_GAP = re.compile(r"[\s/=]*")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
_DROPPED = frozenset("head nav header footer aside button select menu dialog audio video fieldset".split())
#: What goes inside a form; the rest of what a form wraps is a page's text like any other.
_CONTROLS = frozenset("label legend option optgroup datalist output meter progress".split())
#: Says of a form no more than that it is one.
_FORM = re.compile(r"(?:^|(?<=[\s_-]))forms?(?=$|[\s_-])", re.I)
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class and id names that say the same.
_NAMES = re.compile(
    r"(?:^|\s|(?<!with)(?<!has)(?<!no)[_-])(?:nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|foot|side-?bar\w*|aside|ads?|adverts?|advertis\w*|sponsor\w*|promo\w*|banner\w*|"
    r"notices?|notif\w*|alerts?|announce\w*|cookies?|consent\w*|gdpr|popup\w*|modal\w*|overlay|newsletter\w*|subscri\w*|signup|login|forms?|search\w*|"
    r"comment\w*|disqus|respond|replies|share|sharing|social\w*|related\w*|recommend\w*|teasers?|widgets?|toolbar|pagination|pager|copyright|skip|hidden|sr-only)(?=$|[\s_-])",
    re.I,
)
_BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption td th".split()
)
#: Elements of running text; inside an article or main element these are no template, however many pages quote them.
_RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre dd dt td th tr tbody table figcaption caption a b i em strong span u small sub sup code q cite abbr mark time".split())
_WHOLE = frozenset("html body article main".split())
#: What a start tag ends if it is open: itself, up to the nearest of the second.
_ENDS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select"), "tbody": ("tbody thead", "table"), "tfoot": ("tbody thead", "table")}
_ENDS = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ENDS.items()}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def tokens(page: str):
    """(text,) and (tag, whether it ends, attributes, whether it closes itself) in order; each character is looked at once or twice."""
    pos, size = 0, len(page)
    while pos < size:
        at = page.find("<", pos)
        if at < 0:
            yield (page[pos:],)
            return
        ends = page.startswith("</", at)
        name = _NAME.match(page, at + 1 + ends)
        if name is None and not page.startswith(("<!", "<?", "</"), at):
            after = page.find("<", at + 1)
            after = size if after < 0 else after
            yield (page[pos:after],)
            pos = after
            continue
        if at > pos:
            yield (page[pos:at],)
        if name is None:
            close, width = ("-->", 3) if page.startswith("<!--", at) else (">", 1)
            end = page.find(close, at + (4 if width == 3 else 2))
            if end < 0:
                return
            pos = end + width
            continue
        tag, pos, attributes = name[0].lower(), name.end(), []
        while True:
            pos = _GAP.match(page, pos).end()
            if pos >= size:
                return  # a tag that never ends
            if page[pos] == ">":
                break
            m = _ATTRIBUTE.match(page, pos)
            attributes.append((m[1].lower(), m[2] or m[3] or m[4] or ""))
            pos = m.end()
        closed = page[pos - 1] == "/"
        pos += 1
        if tag in _RAW and not ends:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, pos)
            if end is None:
                return
            pos = end.start()
            pos = page.find(">", pos) + 1 or size
            continue
        yield tag, ends, attributes, closed


def _is_dropped(tag: str, attributes: list[tuple[str, str]]) -> bool:
    if tag in _DROPPED:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in attributes:
        if name in ("class", "id"):
            if _NAMES.search(_FORM.sub("", value) if tag == "form" else value):
                return True
        elif name == "role":
            if value.lower() in _ROLES and (tag, value.lower()) != ("form", "form"):
                return True
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _shape(tag: str, attributes: list[tuple[str, str]]) -> str:
    """An element's tag with its classes, id and role, but for digits."""
    return tag + "".join(f" {n}={re.sub(r'[0-9]+', '', v)}" for n, v in attributes if n in ("class", "id", "role"))


class _Open:
    __slots__ = ("tag", "out", "heads", "first", "kept", "hash", "shape", "last", "chars", "linked", "whole", "within", "form", "lifts", "named", "link")

    def __init__(self, tag, shape, out, heads, first, kept, within, form, lifts, link):
        self.tag, self.out, self.heads, self.first, self.kept, self.within, self.form, self.lifts, self.link = tag, out, heads, first, kept, within, form, lifts, link
        self.hash, self.shape, self.last, self.named = xxhash.xxh64(tag), xxhash.xxh64(shape), None, shape != tag or tag in _DROPPED
        self.chars = self.linked = 0
        self.whole = tag in _WHOLE or tag in _HEADINGS and not within


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def candidates_of(page: str) -> tuple[list[tuple[str, int, bool]], list[tuple[int, int, int, int, bool]]]:
    """The blocks of a page and the subtrees that a site may repeat.

    A block is (text, place, whether the rules drop it): the place is 2 inside an
    article element, 1 inside main alone, else 0. A subtree is (hash, its first
    block, the one after its last, its characters, whether the hash is of its
    shape): a hash of texts covers tags and texts, one of shape tags, classes,
    ids and roles, with neighbours of one shape as one. Shapes are listed of
    subtrees outside article and main that have a name or are mostly links, and
    inside them of those that are mostly links. Subtrees that hold the article
    are not listed.
    """
    stack: list[_Open] = [_Open("", "", False, False, 0, 0, 0, False, False, False)]
    blocks: list[tuple[str, int, bool]] = []
    trees: list[tuple[int, int, int, int, bool]] = []
    opened: dict[str, list[int]] = {}  # places in the stack of the open elements of each tag, and under "" of all blocks
    lines = opened.setdefault("", [])
    text: list[str] = []
    aside: list[str] = []
    kept = 0

    def flush(dropped: bool):
        nonlocal kept
        some = aside if dropped else text
        if some:
            joined = " ".join("".join(some).split())
            some.clear()
            if joined:
                at = stack[-1]
                at.hash.update(joined.encode("utf-8", "surrogatepass"))
                at.chars += len(joined)
                blocks.append((joined, at.within, dropped))
                kept += not dropped

    def close():
        at = stack[-1]
        if at.out:
            if at.tag in _BLOCK or not stack[-2].out:
                flush(True)
        elif at.tag in _BLOCK:
            flush(False)
        stack.pop()
        opened[at.tag].pop()
        if at.tag in _BLOCK:
            lines.pop()
        over = stack[-1]
        over.chars += at.chars
        over.linked += at.linked
        shape = at.shape.intdigest()
        if shape != over.last:
            over.last = shape
            over.shape.update(shape.to_bytes(8, "little"))
        if at.whole:
            over.whole = True
        digest = at.hash.intdigest()
        if not at.out or kept > at.kept:
            # what is dropped but for an article or headings inside counts for those around it
            over.hash.update(digest.to_bytes(8, "little"))
        if at.whole or at.first == len(blocks) or at.within and at.tag in _RUNNING and not at.out:
            return
        links = 2 * at.linked > at.chars
        trees.append((_signed(digest), at.first, len(blocks), at.chars, False))
        if links or at.named and not at.within and at.tag not in _RUNNING:
            trees.append((_signed(shape ^ links), at.first, len(blocks), at.chars, True))

    def close_to(i: int):
        while len(stack) > i:
            close()

    for token in tokens(page):
        if len(token) == 1:
            (aside if stack[-1].out else text).append(entities.unescape(token[0]))
            if stack[-1].link:
                stack[-1].linked += len(token[0].strip())
            continue
        tag, ends, attributes, closed = token
        if ends:
            if opened.get(tag):
                close_to(opened[tag][-1])
            continue
        if tag in _VOID:
            (aside if stack[-1].out else text).append(" ")
            if tag == "hr":
                flush(stack[-1].out)
            continue
        if tag in _BLOCK:
            if lines and stack[lines[-1]].tag == "p":
                close_to(lines[-1])
            if tag in _ENDS:
                own, bound = (max((opened[t][-1] for t in tags if opened.get(t)), default=0) for tags in _ENDS[tag])
                if own > bound:
                    close_to(own)
            flush(stack[-1].out)
        over = stack[-1]
        within = 2 if tag == "article" else max(over.within, int(tag == "main"))
        heads, form = over.heads, over.form or tag == "form"
        if over.out:
            # an article anywhere in a form that goes by its name, and headings of an article's own header, are no boilerplate
            lifts = over.lifts and not _is_dropped(tag, attributes)
            out = not (lifts and tag in ("article", "main") or heads and tag in _HEADINGS)
            if not out:
                flush(True)
                if tag in ("article", "main"):
                    heads = False
        else:
            out = form and tag in _CONTROLS or _is_dropped(tag, attributes)
            heads, lifts = out and tag == "header" and within > 0, out and tag == "form"
        stack.append(_Open(tag, _shape(tag, attributes), out, heads, len(blocks), kept, within, form, lifts, over.link or tag == "a"))
        opened.setdefault(tag, []).append(len(stack) - 1)
        if tag in _BLOCK:
            lines.append(len(stack) - 1)
        if closed and tag not in _BLOCK:
            close()
    close_to(1)
    flush(False)
    return blocks, trees


def chosen(blocks: list[tuple[str, int, bool]]) -> list[str]:
    """The main text among the blocks that are no template: without those that the rules drop, and of the article if it holds most of the rest."""
    left = [b for b in blocks if not b[2]]
    size = [sum(len(b[0]) for b in left if b[1] >= least) for least in (0, 1, 2)]
    least = next((k for k in (2, 1) if 2 * size[k] > size[0]), 0)
    return [b[0] for b in left if b[1] >= least]


_TREES = "key long, host long, page long, size long, trees array<struct<tree:long,first:int,end:int,chars:int,shape:boolean>>"
_TREE = pa.list_(pa.struct([("tree", pa.int64()), ("first", pa.int32()), ("end", pa.int32()), ("chars", pa.int32()), ("shape", pa.bool_())]))
_BLOCKS = "key long, page_id long, url string, blocks binary"


def _each(batches, of):
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch = whole.slice(at, 256)
            yield of(batch, [candidates_of(h) for h in batch.column("html").to_pylist()])


def _keyed(pages: DataFrame) -> DataFrame:
    return pages.select(F.xxhash64("page_id", "url", "html").alias("key"), F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64("html").alias("page"), F.coalesce("html", F.lit("")).alias("html"))


def subtrees_of(pages: DataFrame) -> DataFrame:
    """A row a page with its subtrees and its characters."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]*)", 1)), F.lit(""))

    def of(batch, found):
        trees = [[dict(zip(("tree", "first", "end", "chars", "shape"), t, strict=True)) for t in f[1]] for f in found]
        sizes = [sum(len(b[0]) for b in f[0]) for f in found]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sizes, pa.int64()), pa.array(trees, _TREE)], names=["key", "host", "page", "size", "trees"])

    return _keyed(pages).select("key", F.xxhash64(host).alias("host"), "page", "html").mapInArrow(lambda batches: _each(batches, of), _TREES)


def blocks_of(pages: DataFrame) -> DataFrame:
    """A row a page with its blocks, packed as they are shuffled."""

    def of(batch, found):
        packed = [zlib.compress(json.dumps(f[0], ensure_ascii=False).encode("utf-8", "surrogatepass"), 6) for f in found]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(packed, pa.binary())], names=["key", "page_id", "url", "blocks"])

    return _keyed(pages).select("key", "page_id", "url", "html").mapInArrow(lambda batches: _each(batches, of), _BLOCKS)


_TEXT = "page_id long, url string, text string, n_chars long, n_blocks int, n_template int"


def _main_texts(batches):
    """The texts of (page_id, url, blocks, gone): what is left after templates, then after the rules."""
    for whole in batches:
        for at in range(0, len(whole), 256):
            batch = whole.slice(at, 256)
            out = []
            for packed, gone in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                blocks = json.loads(zlib.decompress(packed).decode("utf-8", "surrogatepass"))
                stays = [True] * len(blocks)
                for g in gone or ():
                    stays[g["first"] : g["end"]] = [False] * (g["end"] - g["first"])
                main = chosen([b for b, s in zip(blocks, stays, strict=True) if s])
                text = "\n".join(main)
                out.append((text.encode("utf-8", "surrogatepass").decode("utf-8", "replace"), len(text), len(main), stays.count(False)))
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int32()), strict=True))], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_template"])


def extract(pages: DataFrame, least_pages: int = LEAST_PAGES, share: float = SHARE, shape_share: float = SHAPE_SHARE, thin: float = THIN) -> DataFrame:
    """The main text of every row.

    First what a site repeats goes: every subtree whose texts more than
    least_pages and more than `share` of its host's distinct pages hold, and
    every subtree outside the running text whose shape more than least_pages and
    more than shape_share of them hold and that has at most `thin` of these
    pages' characters, so that what a site shows on most pages goes even if it
    says something else on each. Copies of a page count once, and neither an
    article (or main, or body) itself nor a paragraph inside one is a template,
    as many pages may quote it.

    Then rules go over what is left, which is all of it on hosts of few pages:
    menus, headers, footers, sidebars, notices, adverts, controls of forms and
    comments go by what their elements are or are named. Of the rest the text
    is that of article elements if they hold more than half of its characters,
    else that of main and article if these do, else all.

    A null html is empty and gives an empty text; a null url belongs to one host
    of its own; repeated rows give the same text each; an empty table gives no
    rows; other columns are ignored.

    Subtrees are counted by (host, subtree, page) and then by (host, subtree),
    so a large host's pages meet in one task only as counts. Pages are read and
    parsed once for the counts and once more for their blocks, which costs less
    than to keep all blocks on disk.

    Returns page_id, url, text, n_chars, n_blocks, n_template (blocks that the
    counts deleted).
    """
    disk = Scratch(pages.sparkSession, "pagetext")
    trees = disk.write(subtrees_of(pages), "trees")
    around = trees.where(F.size("trees") > 0).select("key", "host", "page", "size", F.inline("trees"))
    held = around.groupBy("host", "tree", "shape", "page").agg(F.sum("chars").alias("chars"), F.max("size").alias("size"))
    often = held.groupBy("host", "tree", "shape").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("size").alias("size")).where(F.col("n") > least_pages)
    hosts = trees.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    repeated = F.when(F.col("shape"), (F.col("n") > F.col("pages") * shape_share) & (F.col("chars") <= thin * F.col("size"))).otherwise(F.col("n") > F.col("pages") * share)
    templates = often.join(hosts, "host").where(repeated).select("host", "tree", "shape")
    gone = disk.write(around.join(templates, ["host", "tree", "shape"]).groupBy("key").agg(F.collect_set(F.struct("first", "end")).alias("gone")), "gone")
    return blocks_of(pages).join(gone, "key", "left").select("page_id", "url", "blocks", "gone").mapInArrow(_main_texts, _TEXT)


def op5_pagetext(spark, sf_dir):
    return extract(read(spark, sf_dir, "pages"))
