"""HTML extraction by wrapper induction: same-host pages are aligned by simple tree matching.

Each host has a reference page. Every page's tree is laid over it, so that pages share
places; over all pages of the host it is counted where text varies, how many different
texts a place has, how long they are and how much of them is links. Places that never
vary are template. The way to the bulk of the varying text leads to the article; what
lies beside it is judged by what induction knows of its place, and names and kinds of
elements only where that leaves it open, or where too few pages have the place.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hashloom.llm.common import materialize

#: A place whose text never varies is template from so many different pages on.
EVIDENCE = 3
#: Share of its parent's varying text that makes an element the way to the article.
MAIN = 0.5
#: Share of links in an element's text from which on it is a menu, beside that way.
LINKED = 0.6
#: A place has recurring texts if each of them is on so many pages on average.
RECURS = 2
#: Share of the article's mean text below which a block is small.
SMALL = 0.1
#: Hosts' trees and templates are broadcast up to so many bytes, else joined by shuffle.
BROADCAST_BYTES = 32 << 20

# Element kinds of HTML.
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe select".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold text themselves; nameless ones beside the way may be a lead.
PLAIN_TAGS = HEADINGS | frozenset("p blockquote pre figure figcaption".split())
CHROME_TAGS = frozenset("head nav header footer aside form dialog menu button".split())
# Words in class, id and role attributes that name what is not the article.
CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies copyright disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notification pager "
    "pagination popup promo promoted promotion related reply recommended respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe tags teaser toolbar widget".split())
#: Of these, words that inside an article may name its own heading.
OWN_WORDS = frozenset(("header", "banner", "masthead"))

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<|[^<]+""", re.DOTALL)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)


class Page:
    """The block elements of a page in document order: inline elements dissolve into texts, broken nesting is mended.

    tags, names, parents and chrome by element (element 0 is the root); flow: what comes
    in order, (element, text, whether it is a link's), and (element, None, ...) where one begins or ends.
    """

    def __init__(self, html: str):
        self.tags, self.names, self.parents, self.chrome = ["root"], [""], [-1], [False]
        self.flow: list[tuple[int, str | None, bool]] = []
        self._parse(html)

    def _parse(self, html: str):
        stack, links, at, flow = [0], 0, 0, self.flow

        def close(k: int):
            for e in reversed(stack[k:]):
                flow.append((e, None, False))
            del stack[k:]

        while at < len(html):
            m = _TOKEN.match(html, at)
            if m is None:  # a tag that never ends
                break
            at = m.end()
            tag = m[2]
            if tag is None:
                token = m[0]
                if token[:2] not in ("<!", "<?"):
                    flow.append((stack[-1], unescape(token) if "&" in token else token, links > 0))
                continue
            tag, closing = tag.lower(), m[1]
            if tag in RAW:
                if not closing and not m[3].endswith("/"):
                    end = re.compile(f"</{tag}[^>]*>", re.IGNORECASE).search(html, at)
                    at = end.end() if end else len(html)
                flow.append((stack[-1], " ", False))
                continue
            named = ""
            if m[3] and not closing:
                named = " ".join(f"{k.lower()}={v.strip(chr(34) + chr(39)).lower()}" for k, v in _NAMED.findall(m[3]))
            words = set(re.split(r"[^a-z]+", named)) - {"class", "id", "role"} if named else ()
            chrome = tag in CHROME_TAGS or bool(words and not words.isdisjoint(CHROME_WORDS))
            if tag in VOID:
                if tag in ("br", "hr"):
                    flow.append((stack[-1], " ", False))
                continue
            if tag in INLINE and not (chrome and not closing) and not (closing and any(self.tags[e] == tag for e in stack[-2:])):
                if tag == "a":
                    links = max(links + (-1 if closing else 1), 0)
                continue
            if closing:
                for k in range(len(stack) - 1, 0, -1):
                    if self.tags[stack[k]] == tag:
                        close(k)
                        links = 0
                        break
                continue
            if tag == "body":
                close(2 if len(stack) > 1 and self.tags[stack[1]] == "html" else 1)
            elif self.tags[stack[-1]] == "p" and tag not in INLINE:
                close(len(stack) - 1)
            for k in range(len(stack) - 1, 0, -1):
                if self.tags[stack[k]] in CLOSES.get(tag, ()):
                    close(k)
                elif self.tags[stack[k]] in ("ul", "ol", "dl", "table", "div", "article", "main", "section", "select"):
                    break
            links = 0
            self.tags.append(tag)
            self.names.append(re.sub(r"[0-9]+", "", named))
            self.parents.append(stack[-1])
            self.chrome.append(chrome)
            stack.append(len(self.tags) - 1)
            flow.append((stack[-1], None, False))
        close(0)

    def keys(self) -> list[str]:
        """What tells an element from its siblings: kind and name without digits; of nameless containers also the kinds inside."""
        inside: list[set[str]] = [set() for _ in self.tags]
        for tag, parent in zip(self.tags[1:], self.parents[1:]):
            inside[parent].add(tag)
        return [f"{t} {n}" if n or t not in ("div", "section") else f"{t} {' '.join(sorted(i))}" for t, n, i in zip(self.tags, self.names, inside)]


class Tree:
    """Elements folded into slots: siblings of one key are one slot, so that a slot's children have different keys.

    parents and keys by slot, a slot after its parent, siblings in order of first appearance.
    """

    def __init__(self, parents: list[int], keys: list[str]):
        self.parents, self.keys = parents, keys
        self.kids: list[dict[str, int]] = [{} for _ in parents]
        for s in range(1, len(parents)):
            self.kids[parents[s]][keys[s]] = s

    @classmethod
    def of(cls, page: Page) -> tuple[Tree, list[int]]:
        """(tree, slot of each element)."""
        slots, parents, keys, slot_of = {}, [-1], ["root"], [0]
        for key, parent in zip(page.keys()[1:], page.parents[1:]):
            place = (slot_of[parent], key)
            if place not in slots:
                slots[place] = len(parents)
                parents.append(place[0])
                keys.append(key)
            slot_of.append(slots[place])
        return cls(parents, keys), slot_of


def tree_match(a: Tree, b: Tree) -> tuple[int, list[int]]:
    """Simple tree matching: (most node pairs that an order-keeping, level-keeping match can have, b's partner in a of each slot or -1).

    Children have different keys, so each has one possible partner, and the best match
    of two child lists is the heaviest run of partners that ascends in both: n log n.
    """
    pairs, at = [(0, 0)], 0
    inner: list[list[int]] = []  # of each pair: pairs of children, in b's order
    while at < len(pairs):
        x, y = pairs[at]
        inner.append([])
        for key, kid in b.kids[y].items():
            if (other := a.kids[x].get(key)) is not None:
                inner[at].append(len(pairs))
                pairs.append((other, kid))
        at += 1
    weight, chosen = [1] * len(pairs), [[] for _ in pairs]
    for p in range(len(pairs) - 1, -1, -1):
        chosen[p] = _heaviest([pairs[k][0] for k in inner[p]], [weight[k] for k in inner[p]])
        weight[p] += sum(weight[inner[p][i]] for i in chosen[p])
    partner, todo = [-1] * len(b.parents), [0]
    while todo:
        p = todo.pop()
        partner[pairs[p][1]] = pairs[p][0]
        todo += [inner[p][i] for i in chosen[p]]
    return weight[0], partner


def _heaviest(values: list[int], weights: list[int]) -> list[int]:
    """Indices of the ascending subsequence of greatest weight (values differ)."""
    tops: list[tuple[int, int, int]] = []  # (last value, weight, index): both ascend
    back = [-1] * len(values)
    for i, (v, w) in enumerate(zip(values, weights)):
        k = bisect_left(tops, (v,))
        if k:
            w, back[i] = w + tops[k - 1][1], tops[k - 1][2]
        end = k
        while end < len(tops) and tops[end][1] <= w:
            end += 1
        tops[k:end] = [(v, w, i)]
    out, i = [], tops[-1][2] if tops else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def places(tree: Tree, reference: Tree) -> list[int]:
    """A 63-bit number for each slot of a page: that of its partner in the reference, else one by its own parent's place."""
    name = lambda x: xxhash.xxh64_intdigest(x) >> 1
    _, partner = tree_match(reference, tree)
    of_reference = [name("root")]
    for s in range(1, len(reference.parents)):
        of_reference.append(name(f"{of_reference[reference.parents[s]]}/{reference.keys[s]}"))
    out = []
    for s, p in enumerate(partner):
        out.append(of_reference[p] if p >= 0 else name(f"{out[tree.parents[s]]}+{tree.keys[s]}"))
    return out


def texts_of(page: Page, slot_of: list[int]) -> dict[int, tuple[str, int, int]]:
    """By slot with any text of its own: (text, characters outside links, inside links)."""
    parts: dict[int, list[str]] = {}
    sizes: dict[int, list[int]] = {}
    for element, text, linked in page.flow:
        if text is not None and not text.isspace():
            s = slot_of[element]
            parts.setdefault(s, []).append(text)
            sizes.setdefault(s, [0, 0])[linked] += len(text.strip())
    return {s: (" ".join(" ".join(p).split()), *sizes[s]) for s, p in parts.items()}


def extract(html: str, reference: Tree | None = None, template: dict[int, tuple[bool, float, float, bool]] | None = None) -> str:
    """The main text of a page.

    template: by place, whether its text never varies, its mean characters outside and
    inside links, and whether its texts recur on other pages. Template places give no
    text, headings excepted. From the root down, the child with MAIN of the varying,
    unlinked text is the way to the article. What lies on it stays, whatever its name.

    A block beside the way goes if most of its text is links, or recurs. Else, where the
    host's pages tell of its place, it also goes if it is SMALL or comes after the article,
    but for plain text elements without a name; of those that are left a name or kind of
    CHROME_WORDS and CHROME_TAGS drops one. Within the article such names and kinds drop a
    block that is SMALL, recurs or has a third of links, and a SMALL block with any name
    goes if its texts recur. Of a place that too few pages have only names, kinds and links
    tell.
    """
    page = Page(html)
    tree, slot_of = Tree.of(page)
    place, known, own = places(tree, reference or tree), template or {}, texts_of(page, slot_of)
    n = len(tree.parents)
    kinds = [key.split(" ")[0] for key in tree.keys]
    still = [place[s] in known and known[place[s]][0] and kinds[s] not in HEADINGS for s in range(n)]
    plain, linked, again, told = [0.0] * n, [0.0] * n, [0.0] * n, [0.0] * n  # of those: text that recurs, text of places that are known
    for s, (_, a, b) in own.items():
        if not still[s]:
            met = place[s] in known
            plain[s], linked[s] = known[place[s]][1:3] if met else (a, b)
            again[s] = plain[s] + linked[s] if met and known[place[s]][3] else 0.0
            told[s] = plain[s] + linked[s] if met else 0.0
    for s in range(n - 1, 0, -1):
        for sums in (plain, linked, again, told):
            sums[tree.parents[s]] += sums[s]
    elements = [0] * n
    for s in slot_of:
        elements[s] += 1
    way, end = {0}, 0  # not into rows and cells of a table that has several alike
    while tree.kids[end]:
        top = max(tree.kids[end].values(), key=lambda s: plain[s])
        if plain[top] < MAIN * plain[end] or plain[top] == 0 or kinds[top] in ("p", "li") or kinds[top] in ("td", "tr") and elements[top] > 1:
            break
        way.add(end := top)
    under = [False] * n  # the end of the way
    for s in range(n):
        under[s] = s == end or s > 0 and under[tree.parents[s]]
    drop = [False] * len(page.tags)
    for e in range(1, len(page.tags)):
        s = slot_of[e]
        if drop[page.parents[e]] or s in way:
            drop[e] = drop[page.parents[e]]
            continue
        words = set(re.split(r"[^a-z]+", page.names[e]))
        every = plain[s] + linked[s]
        recurs, small, evident = again[s] > every / 2, plain[s] < SMALL * plain[end], told[s] > every / 2
        if under[s]:
            heads = page.tags[e] not in CHROME_TAGS - {"header"} and not words & (CHROME_WORDS - OWN_WORDS)  # an article's own header
            doubt = not evident or small or recurs or linked[s] > every / 3
            drop[e] = page.chrome[e] and not heads and doubt or bool(page.names[e]) and recurs and small
        else:
            lead = page.tags[e] in PLAIN_TAGS and not page.names[e]
            drop[e] = linked[s] > LINKED * every or recurs or page.chrome[e] or evident and not lead and (small or s > end)
    out = []
    for element, text, _ in page.flow:
        if not drop[element]:
            out.append(" " if text is None else "" if still[slot_of[element]] else text)
    return " ".join("".join(out).split())


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit(""))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def _with(rows: DataFrame, hosts: DataFrame, column: str) -> tuple[DataFrame, Callable[[str, str | None], str | None]]:
    """(``rows`` with a string ``column``, a function of a row's host and that cell): what ``hosts`` has of each host.

    Behind a check of its size the table is broadcast once to the workers, and cells stay
    null; a larger one comes in the cells, by a shuffled join.
    """
    size = hosts.agg(F.sum(F.octet_length(column) + F.octet_length("host") + 64)).head()[0] or 0
    if size > BROADCAST_BYTES:
        return rows.join(hosts, "host", "left"), lambda host, cell: cell
    shared = rows.sparkSession.sparkContext.broadcast({r["host"]: r[column] for r in hosts.collect()})  # at most BROADCAST_BYTES
    return rows.withColumn(column, F.lit(None).cast("string")), lambda host, cell: shared.value.get(host)


def references(hosted: DataFrame) -> DataFrame:
    """(host, tree): the folded tree of each host's page of least hash, as JSON."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[str, tuple[int, str]] = {}

        def out() -> pa.RecordBatch:
            trees = [Tree.of(Page(html))[0] for _, html in least.values()]
            return pa.RecordBatch.from_arrays([
                pa.array(least, pa.string()), pa.array([h for h, _ in least.values()], pa.int64()), pa.array([json.dumps([t.parents, t.keys]) for t in trees], pa.string())],
                names=["host", "turn", "tree"])

        for batch in batches:
            for host, turn, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if host and (host not in least or turn < least[host][0]):
                    least[host] = turn, html
            if len(least) > 512:
                yield out()
                least = {}
        if least:
            yield out()

    found = hosted.where("html <> ''").select("host", F.xxhash64("html").alias("turn"), "html").mapInArrow(run, "host string, turn bigint, tree string")
    return materialize(found.groupBy("host").agg(F.min_by("tree", "turn").alias("tree")), "references")


def induce(hosted: DataFrame, trees: DataFrame) -> DataFrame:
    """(host, tree, template): templates count over all pages of a host; those that are equal count once.

    template: JSON of [place, never varies, mean characters outside links, inside links,
    texts recur] of each place that EVIDENCE different pages have.
    """
    given, told = _with(hosted.where("host <> ''"), trees, "tree")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree_of = lru_cache(256)(lambda shape: Tree(*json.loads(shape)))
        for batch in batches:
            rows = []
            for name, shape, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                shape = told(name, shape)
                if shape is None:
                    continue
                page, tree = Page(html), tree_of(shape)
                own, slot_of = Tree.of(page)
                place, digest = places(own, tree), xxhash.xxh64_intdigest(html) >> 1
                rows += [(name, place[s], digest, xxhash.xxh64_intdigest(t) >> 1, a, b) for s, (t, a, b) in texts_of(page, slot_of).items()]
            if rows:
                kinds = (pa.string(), *[pa.int64()] * 5)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["host", "place", "page", "text", "plain", "linked"])

    met = given.select("host", "tree", "html").mapInArrow(
        run, "host string, place bigint, page bigint, text bigint, plain bigint, linked bigint")
    each = met.groupBy("host", "place", "page").agg(F.min("text").alias("text"), F.min("plain").alias("plain"), F.min("linked").alias("linked"))
    texts = each.groupBy("host", "place", "text").agg(F.count("*").alias("n"), F.sum("plain").alias("plain"), F.sum("linked").alias("linked"))
    sums = texts.groupBy("host", "place").agg(
        F.sum("n").alias("n"), F.count("*").alias("texts"), F.sum("plain").alias("plain"), F.sum("linked").alias("linked")).where(F.col("n") >= EVIDENCE).select(
        "host", "place", (F.col("texts") == 1).alias("still"), (F.col("plain") / F.col("n")).alias("plain"), (F.col("linked") / F.col("n")).alias("linked"),
        (F.col("texts") * RECURS <= F.col("n")).alias("recurs"))
    found = sums.groupBy("host").agg(F.to_json(F.sort_array(F.collect_list(F.struct("place", "still", "plain", "linked", "recurs")))).alias("template"))
    return materialize(trees.join(found, "host", "left").select("host", F.struct("tree", F.coalesce("template", F.lit("[]")).alias("template")).alias("wrapper")).select(
        "host", F.to_json("wrapper").alias("wrapper")), "templates")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages`` (page_id, url, html, others ignored).

    Each host's template is induced over all its pages, in two passes over the table: one
    aligns every page with the host's reference and counts, by place, different pages
    and texts; one extracts. No grouping of pages into tasks or batches changes an answer.
    A host's only page, pages without host, and hosts of fewer than EVIDENCE different
    pages have no template, and go by the weight of their texts, kinds and names alone.
    A null or empty html gives an empty text. Repeated rows each get a row, and
    count once in a template; null page_ids and urls stay. Long and deeply nested pages
    are read whole, in time linear in their length but for sorting. An empty table gives none.
    """
    hosted = _hosted(pages)
    given, told = _with(hosted, induce(hosted, references(hosted)), "wrapper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @lru_cache(256)
        def read(wrapper: str | None):
            if wrapper is None:
                return None, None
            known = json.loads(wrapper)
            return Tree(*json.loads(known["tree"])), {x["place"]: (x["still"], x["plain"], x["linked"], x["recurs"]) for x in json.loads(known["template"])}

        for batch in batches:
            hosts, htmls, cells = (batch.column(i).to_pylist() for i in (4, 2, 3))
            texts = [extract(html, *read(told(host, cell))) for host, html, cell in zip(hosts, htmls, cells)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    key = pages.schema["page_id"].dataType.simpleString()
    return given.select("page_id", "url", "html", "wrapper", "host").mapInArrow(run, f"page_id {key}, url string, text string, n_chars bigint")
