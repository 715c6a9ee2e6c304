"""Main text of web pages by consensus host paths.

1. Each page is cut into blocks of text inside a tree of containers. A container is scored by the text below it that is neither
   boilerplate nor mostly links; deeper containers win as long as they keep most of it, and article-like ones count double.
2. The best container of a page votes for its generalised path (tags and class names from the root, digits removed, no ids or
   positions). Votes are added up per host and path in Spark; the path with the most votes, then the most text, wins its host, and
   so does every other layout with a tenth of the host's votes (two or more).
3. Every page is read again and gives the blocks below that winning path of its host which holds most of its text, weighted by
   votes, or below its own best container if it has none of them.

Boilerplate (``DROPPED`` elements, and containers with a word of ``MARKED`` in class, id or role, see ``Page._spare``) is left out in any case.
A form, field set or dialog around an article is a container like any other, without its labels. A header inside an article
or main element gives its headings only; any other header gives nothing.
Inside a block, runs of white space are one space; a line break element is white space. Blocks are joined by one line feed.

Defined results: a null or empty html gives an empty text; a null url belongs to the host ''; repeated pages vote once
each and give equal texts; unclosed and misnested elements end with their parent; a truncated tag or character reference stays out or as it is; an
empty table gives an empty one. Other columns of the input are kept; ``text`` and ``n_chars`` are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from hashlib import md5

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sharegate.llm.common import quoted, stored
from sharegate.operators.joins import lookup_join

#: Elements whose content is never main text.
DROPPED = frozenset("""script style noscript template svg math canvas iframe object embed audio video map head title nav header footer aside
menu select datalist button textarea""".split())
#: Words of class, id or role that mark menus, notices, adverts, comments and the like.
MARKED = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice
notices popup modal overlay sidebar sidebars widget widgets related recommended recommendations share sharing social newsletter
subscribe subscription signup breadcrumb breadcrumbs menu menus nav navbar navigation footer header masthead comment comments disqus
replies respond responses reactions feedback discussion discussions talkback guestbook pagination pager toolbar login search skip complementary contentinfo alert""".split())
#: Words of class or id that turn a marked word into a word about the layout.
MODIFIERS = frozenset("has have no not with without is open opened closed on off enabled disabled".split())
#: A name with a word of each marks what readers wrote.
READERS = frozenset("user users reader readers visitor visitors member members guest guests customer customers".split())
WRITTEN = frozenset("post posts opinion opinions review reviews reply message messages note notes contribution contributions submission submissions".split())
#: Elements that are dropped unless they hold the article.
FORMS = frozenset("form fieldset dialog".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id or role that mark an article.
ARTICLE = frozenset("article main content entry post story articlebody body text".split())
#: Elements that begin and end a block.
BLOCKS = frozenset("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3
h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul""".split())
CONTAINERS = frozenset("html body div section article main td center blockquote figure details table tbody tr ul ol dl".split())
#: Containers that are a part of the text around them.
INNER = frozenset("blockquote figure details table tbody tr td ul ol dl".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the value ends where the key begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
STOPS = frozenset("ul ol dl table select body html".split())
#: A longer path goes on from its digest, so that deep nesting takes linear memory.
LONG_PATH = 2000

# a quote only opens a value right behind an equals sign
_TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(script|style|textarea|title|noscript|iframe|template)(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
                    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>=]++|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)(?:>|\Z)", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*))?")
_SPLIT = re.compile(r"[^a-z]+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """``nodes``: (parent, path, depth, dropped, doubled) of each container; ``blocks``: (node, text, characters in links)."""

    def __init__(self, source: str):
        self.nodes, self.blocks = [(-1, "", 0, False, False)], []
        self.parts, self.links = [], 0
        self.marks: dict[int, int] = {}  # containers with a marked name, and how surely it means boilerplate
        self.headed = set()  # containers with an h1
        self.forms: set[int] = set()
        self.telling = set()  # containers with an article-like one
        self.titled: dict[int, int] = {}  # containers of a header inside an article, and where its headings go
        stack = [("", 0)]  # element name, node
        opened: Counter[str] = Counter()  # names on the stack, so that no search walks it in vain

        def cut(k: int) -> None:
            opened.subtract(x for x, _ in stack[k:])
            del stack[k:]

        in_link, at = 0, 0
        for m in _TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at:m.start()], in_link)
            at = m.end()
            name = m[3]
            if not name:
                if m[1] and m[1].lower() == "textarea":
                    self._text(" ", 0)
                continue
            name = name.lower()
            if m[2]:
                if name == "a":
                    in_link = max(0, in_link - 1)
                elif name in BLOCKS or name in DROPPED or name in FORMS or name == "label":
                    if name != "label" or stack[-1][0] == "label":
                        self._end(stack[-1][1])
                    if opened[name]:
                        cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
                        in_link = 0
                continue
            if name == "br":
                self.parts.append(" ")
            if name == "a":
                in_link += not m[4].rstrip().endswith("/")
            label = name == "label" and any(opened[x] for x in FORMS)
            if name not in BLOCKS and name not in DROPPED and name not in FORMS and not label:
                continue
            self._end(stack[-1][1])
            in_link = 0
            if stack[-1][0] == "p":
                cut(len(stack) - 1)
            if any(opened[x] for x in CLOSES.get(name, ())):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][0] in STOPS and stack[k][0] != name:
                        break
                    if stack[k][0] in CLOSES[name]:
                        cut(k)
                        break
            if name in VOID:
                continue
            node = stack[-1][1]
            marked, article, classes = self._marks(m[4])
            if name in HEADINGS:
                node = self.titled.get(node, node)
            if name in CONTAINERS or name in DROPPED or name in FORMS or label or marked:
                above, parent = node, self.nodes[node]
                path = f"{parent[1] if len(parent[1]) < LONG_PATH else '#' + md5(parent[1].encode()).hexdigest()}/{name}" + "".join(f".{c}" for c in classes)
                dropped = parent[3] or name in DROPPED or label
                if name in FORMS:
                    self.forms.add(len(self.nodes))
                if name == "header" and (opened["article"] or opened["main"]):
                    self.titled[len(self.nodes)] = node
                elif above in self.titled and name not in DROPPED:
                    self.titled[len(self.nodes)] = self.titled[above]
                if marked and name not in ("html", "body") and (marked == 3 or name not in ("article", "main")):
                    self.marks[len(self.nodes)] = marked
                self.nodes.append((node, path, parent[2] + 1, dropped, name in ("article", "main") or article and name in ("div", "section", "td")))
                node = len(self.nodes) - 1
                if self.nodes[node][4]:
                    self._up(self.telling, node)
            if name == "h1":
                self._up(self.headed, node)
            stack.append((name, node))
            opened[name] += 1
        if at < len(source):
            self._text(source[at:], in_link)
        self._end(stack[-1][1])
        self._spare()

    def _up(self, found: set[int], node: int) -> None:
        while node >= 0 and node not in found:
            found.add(node)
            node = self.nodes[node][0]

    @staticmethod
    def _marks(attributes: str) -> tuple[int, bool, list[str]]:
        """How surely boilerplate (0 no, 1 a name ends with or holds a marked word, 2 a name begins with one, 3 by its role), whether
        article-like, and the generalised class names. A name with a modifier tells of the layout, not of the container."""
        mark, article, classes = 0, False, []
        for m in _ATTRIBUTE.finditer(attributes or ""):
            kind, value = m[1].lower(), (m[2] or "").strip("\"'")
            if kind not in ("class", "id", "role"):
                continue
            for name in value.split():
                words = [x for x in _SPLIT.split(_HUMP.sub("-", name).lower()) if x]
                article |= not ARTICLE.isdisjoint(words)
                if not MARKED.isdisjoint(words) and MODIFIERS.isdisjoint(words):
                    mark = max(mark, 3 if kind == "role" else 2 if words[0] in MARKED else 1)
                elif not READERS.isdisjoint(words) and not WRITTEN.isdisjoint(words):
                    mark = max(mark, 2)
            if kind == "class":
                classes += [x for x in dict.fromkeys(re.sub(r"\d+", "", value.lower()).split()) if x]
        return mark, article, sorted(classes)

    def _spare(self) -> None:
        """Settle ``dropped`` of the marked containers and of forms: articles, and those that hold most of the page's unlinked text (nearly all of
        it, if their name begins with a marked word, or for a form without heading or article-like part), are not dropped for a name."""
        if not self.marks and not self.forms:
            return
        held = [0] * len(self.nodes)
        for node, text, links in self.blocks:
            if not self.nodes[node][3] and 2 * links <= len(text):
                held[node] += len(text) - links
        for k in range(len(self.nodes) - 1, 0, -1):
            held[self.nodes[k][0]] += held[k]
        for k, (parent, path, depth, dropped, doubled) in enumerate(self.nodes):
            mark = self.marks.get(k, 0)
            most, nearly = 2 * held[k] > held[0], 10 * held[k] > 9 * held[0]
            out = mark == 3 or mark == 2 and not nearly or mark == 1 and not most
            out |= k in self.forms and not (nearly or most and (k in self.headed or k in self.telling))
            self.nodes[k] = (parent, path, depth, dropped or out or parent >= 0 and self.nodes[parent][3], doubled)

    def _text(self, raw: str, in_link: int) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self.parts.append(text)
        if in_link:
            self.links += len(text)

    def _end(self, node: int) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append((node, text, self.links))
        self.parts, self.links = [], 0

    def held(self) -> list[float]:
        """Text below each container. Text of mostly links does not count."""
        own = [0.0] * len(self.nodes)
        for node, text, links in self.blocks:
            if not self.nodes[node][3] and 2 * links <= len(text):
                own[node] += len(text) - links
        for k in range(len(self.nodes) - 1, 0, -1):  # parents come before their children
            own[self.nodes[k][0]] += own[k]
        return own

    def best(self) -> tuple[int, float]:
        """The container with the best score."""
        own = self.held()
        score = [t * 1.25 ** min(n[2], 50) * (2 if n[4] else 1) for t, n in zip(own, self.nodes, strict=True)]
        best = self._climbed(max(range(len(score)), key=score.__getitem__), own)
        return best, own[best]

    def _climbed(self, best: int, own: list[float]) -> int:
        """The outermost container around the best one whose further text belongs to it: its outermost article (or main) element,
        then containers that add mostly text of their own, parts of the same kind as the one below, or a part with the page's heading."""
        chain = [best]
        while self.nodes[chain[-1]][0] >= 0:
            chain.append(self.nodes[chain[-1]][0])
        names = [self.nodes[k][1].rpartition("/")[2].partition(".")[0] for k in chain]
        at = next((len(chain) - 1 - names[::-1].index(x) for x in ("article", "main") if x in names), 0)
        children: dict[int, list[int]] = {}
        for k, n in enumerate(self.nodes):
            if not n[3]:
                children.setdefault(n[0], []).append(k)
        chosen, belongs = chain[at], 0.0
        for below, k, name in zip(chain[at:], chain[at + 1:], names[at + 1:]):
            belongs += own[k] - sum(own[c] for c in children.get(k, ()))  # blocks of its own
            for c in children.get(k, ()):
                kind = self.nodes[c][1].rpartition("/")[2]
                if c != below and (self.nodes[c][1] == self.nodes[below][1] or kind.partition(".")[0] in INNER or c in self.headed and name not in ("body", "html", "")):
                    belongs += own[c]
            more = own[k] - own[chosen]
            if more > 0 and 2 * belongs >= more:
                chosen, belongs = k, 0.0
        return chosen

    def text(self, paths: list[tuple[str, int]] | None) -> str:
        """Blocks below the path of ``paths`` (with votes) that holds most text times votes; ties go to the first one. Below the best container if none holds text."""
        at: dict[str, list[int]] = {path: [] for path, _ in paths or ()}
        for k, n in enumerate(self.nodes):
            if n[1] in at and not n[3]:
                at[n[1]].append(k)
        roots, most = set(), 0.0
        if len(at) == 1:
            roots = set(*at.values())
        elif at:
            own = self.held()
            for path, votes in paths:
                if votes * sum(own[k] for k in at[path]) > most:
                    roots, most = set(at[path]), votes * sum(own[k] for k in at[path])
        if not roots:
            roots = {self.best()[0]}
        inside = [False] * len(self.nodes)
        for k, n in enumerate(self.nodes):
            inside[k] = k in roots or n[0] >= 0 and inside[n[0]]
        return "\n".join(text for node, text, _ in self.blocks if inside[node] and not self.nodes[node][3])


def host_of(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def host_paths(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(host, paths): the winning paths of each host with their votes, most votes first: the first one, and every other with two votes and a
    tenth of the host's, so ten or so. Votes are aggregated before they are shuffled, and no task sorts the paths of a host."""
    rows = pages.select(host_of(F.col(quoted(url))).alias("host"), F.col(quoted(html)).cast("string").alias("html"))

    def vote(batches):
        for batch in batches:
            paths, scores = [], []
            for source in batch.column("html"):
                page = Page(source.as_py() or "")
                node, score = page.best()
                paths.append(page.nodes[node][1] if score else None)
                scores.append(int(score))
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(paths, pa.string()), pa.array(scores, pa.int64())], names=["host", "path", "chars"])

    votes = rows.mapInArrow(vote, "host string, path string, chars long").where("path IS NOT NULL") \
                .groupBy("host", "path").agg(F.count(F.lit(1)).alias("votes"), F.sum("chars").alias("chars"))
    sums = votes.groupBy("host").agg(F.sum("votes").alias("all"), F.max(F.struct("votes", "chars")).alias("top"))
    first = F.struct("votes", "chars") == F.col("top")
    near = votes.join(sums, "host").where(first | (F.col("votes") >= 2) & (10 * F.col("votes") >= F.col("all")))
    others = F.collect_list(F.when((F.col("votes") >= 2) & (10 * F.col("votes") >= F.col("all")), F.struct((-F.col("votes")).alias("less"), (-F.col("chars")).alias("short"), "path")))
    leading = F.min(F.when(first, F.struct((-F.col("votes")).alias("less"), (-F.col("chars")).alias("short"), "path")))
    won = near.groupBy("host").agg(F.sort_array(F.array_distinct(F.concat(F.array(leading), others))).alias("w"))
    return won.select("host", F.transform("w", lambda x: F.struct(x["path"].alias("path"), (-x["less"]).alias("votes"))).alias("paths"))


def main_text(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """The input with ``text`` and ``n_chars``."""
    pages = pages.drop("text", "n_chars")
    winners = stored(host_paths(pages, url, html).select(F.col("host").alias("_host"), F.col("paths").alias("_paths")))
    named = pages.select(F.struct("*").alias("_row"), F.col(quoted(html)).cast("string").alias("_html"), host_of(F.col(quoted(url))).alias("_host"))
    joined = lookup_join(named, winners, ["_host"], spread_by="_html")
    schema = T.StructType([T.StructField("_row", pages.schema), T.StructField("_text", T.StringType()), T.StructField("_n", T.LongType())])

    def extract(batches):
        for batch in batches:
            texts = [Page(source.as_py() or "").text([(p["path"], p["votes"]) for p in paths.as_py() or ()])
                     for source, paths in zip(batch.column("_html"), batch.column("_paths"), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                             names=["_row", "_text", "_n"])

    found = joined.select("_row", "_html", "_paths").mapInArrow(extract, schema)
    return found.select("_row.*", F.col("_text").alias("text"), F.col("_n").alias("n_chars"))
