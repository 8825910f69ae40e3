"""HTML extraction: boosted trees judge the nodes of a page, a decoding over the tree chooses."""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docflow.llm.common import query, steady

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# How HTML names its elements, and words that pages name their parts with.
_SKIPPED = "script style title textarea iframe noframes noembed template svg math select noscript canvas audio video button object datalist".split()
_VOID = "area base br col embed hr img input link meta param source track wbr".split()
_BLOCK = (
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul"
).split()
_KINDS = {
    "p": "p", "h": "h1 h2 h3 h4 h5 h6 hgroup", "li": "li dd dt", "cell": "td th caption", "box": "div center address", "article": "article", "main": "main",
    "section": "section details", "nav": "nav menu dir", "aside": "aside", "header": "header", "footer": "footer", "form": "form fieldset legend search dialog",
    "list": "ul ol dl", "table": "table tbody thead tfoot tr", "quote": "blockquote pre", "figure": "figure figcaption",
}
_NAMED = {
    "nav": "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc tabs skip",
    "head": "header masthead topbar banner branding logo site",
    "foot": "footer copyright colophon bottom legal imprint contentinfo",
    "side": "sidebar aside side rail secondary complementary widget widgets",
    "note": "cookie cookies consent gdpr notice notification alert modal popup overlay toast privacy",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense",
    "form": "form search searchbox login signup subscribe subscription newsletter contact",
    "talk": "comment comments commentlist disqus reply replies respond discussion thread",
    "more": "related recommended recommendations share sharing social popular trending teaser teasers links tags",
    "main": "article articlebody content post entry story main body text prose",
}
_CLOSES = {  # a start tag ends open elements of the first group, up to one of the second
    "li": ("li", "ul ol menu dir table"), "dd": ("dd dt", "dl table"), "dt": ("dd dt", "dl table"), "td": ("td th", "table"), "th": ("td th", "table"),
    "tr": ("tr", "table"), "tbody": ("tbody thead tfoot tr", "table"), "thead": ("tbody thead tfoot tr", "table"), "tfoot": ("tbody thead tfoot tr", "table"),
}
_CLOSES = {tag: (a.split(), b.split()) for tag, (a, b) in _CLOSES.items()}

_MARK = ""  # stands before main text in training pages
_GROUP = 4_000_000  # characters of pages that are judged together
_NAMES = {word: 1 << k for k, words in enumerate(_NAMED.values()) for word in words.split()}
_KIND = {tag: k + 1 for k, tags in enumerate(_KINDS.values()) for tag in tags.split()}
_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)"
    r"""|<(/?)([A-Za-z][^\s/<>"'=]*+)((?:[^<>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?|["'])*+)>"""
    r"|<[!?/][^>]*+(?:>|\Z)|<[A-Za-z][^<>]*+\Z|([^<]++|<)", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"']+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_END = re.compile(r"[.!?。！？…]")


class Tree:
    """Blocks of a page in page order: elements that are blocks, and runs of text in them.

    ``parent`` comes before its children; ``stop`` is one past the last node below. Runs of
    text have ``texts``; in-line elements belong to the run they stand in.
    """

    def __init__(self, html: str):
        self.parent, self.depth, self.stop, self.kind, self.names = [-1], [0], [0], [0], [0]
        self.texts: list[str | None] = [None]
        self.linked, self.tags, self.hidden = [0], [0], [0]
        self._stack, self._open = [0], {}
        self._run, self._in_link, self._link_level = [], False, 0
        self._seen: dict[str, tuple[int, int]] = {}
        self._read(html)

    def _read(self, html: str) -> None:
        at, skipped = 0, set(_SKIPPED)
        block, void = set(_BLOCK), set(_VOID)
        match = _TOKEN.match
        while m := match(html, at):
            at = m.end()
            text, tag = m[4], m[2]
            if text is not None:
                self._run.append((text, self._in_link))
            elif tag is not None:
                tag = tag.lower()
                if m[1]:
                    if tag == "a":
                        self._in_link = False
                    elif tag in block and tag not in ("body", "html"):
                        self._flush()
                        if places := self._open.get(tag):
                            self._close(places[-1])
                    elif tag == "br":
                        self._run.append((" ", False))
                elif tag in skipped:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(html, at)
                    at = end.end() if end else len(html)
                elif tag in block:
                    self._start(tag, m[3])
                else:
                    self.tags[self._stack[-1]] += 1
                    if tag == "a":
                        self._in_link, self._link_level = True, len(self._stack)
                    elif tag == "hr":
                        self._flush()
                    elif tag in ("br", "wbr") or tag in void:
                        self._run.append((" " if tag != "wbr" else "", False))
            if at >= len(html):
                break
        self._flush()
        self._close(0)

    def _start(self, tag: str, attributes: str) -> None:
        self._flush()
        last = lambda tags: max((self._open[t][-1] for t in tags if self._open.get(t)), default=0)
        if tag not in ("html", "body", "head") and last(["p"]) > last(("table", "td", "th", "caption")):
            self._close(last(["p"]))
        if tag in _CLOSES:
            ends, within = _CLOSES[tag]
            bound = last(within)
            inside = [self._open[t][-1] for t in ends if self._open.get(t) and self._open[t][-1] > bound]
            if inside:
                self._close(min(inside))
        if tag == "body" and self._open.get("head"):
            self._close(self._open["head"][-1])
        names, hidden = self._named(attributes)
        self._open.setdefault(tag, []).append(len(self._stack))
        self._stack.append(self._node(tag, names, hidden))

    def _named(self, attributes: str) -> tuple[int, int]:
        if not attributes:
            return 0, 0
        if attributes not in self._seen:
            parts = [p.lower() for _, v in _ATTRIBUTE.findall(attributes) for p in _PART.findall(v)]
            bits = 0
            for part in parts:
                bits |= _NAMES.get(part, 0)
            self._seen[attributes] = bits, int(bool(_HIDDEN.search(attributes)))
        return self._seen[attributes]

    def _node(self, tag: str | None, names: int = 0, hidden: int = 0, text: str | None = None, linked: int = 0) -> int:
        up = self._stack[-1]
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.stop.append(len(self.parent))
        self.kind.append(_KIND.get(tag, 0) if tag else self.kind[up])
        self.names.append(names)
        self.texts.append(text)
        self.linked.append(linked)
        self.tags.append(int(tag is not None))
        self.hidden.append(hidden)
        return len(self.parent) - 1

    def _close(self, level: int) -> None:
        while len(self._stack) > max(level, 1):
            self.stop[self._stack.pop()] = len(self.parent)
        if level == 0:
            self.stop[0] = len(self.parent)
        for tag, places in self._open.items():
            while places and places[-1] >= len(self._stack):
                places.pop()
        if self._link_level > len(self._stack):
            self._in_link = False

    def _flush(self) -> None:
        from html import unescape

        if not self._run:
            return
        whole = "".join(t for t, _ in self._run)
        text = " ".join((unescape(whole) if "&" in whole else whole).split())
        if text:
            self._node(None, text=text, linked=min(len(text), sum(len(t.strip()) for t, linked in self._run if linked)))
        self._run.clear()


def features(trees: list[Tree]):
    """One row of numbers per node of all trees, the trees one after another."""
    import numpy as np

    each = lambda name: np.array([x for t in trees for x in getattr(t, name)], np.int64)
    sizes = np.array([len(t.parent) for t in trees])
    first = np.repeat(np.cumsum(sizes) - sizes, sizes)
    n = int(sizes.sum())
    index = np.arange(n)
    parent, stop = each("parent"), each("stop") + first
    top = parent < 0
    up = np.where(top, index, parent + first)
    texts = [x for t in trees for x in t.texts]
    leaf = np.array([x is not None for x in texts])
    chars = np.array([len(x.lstrip(_MARK)) if x else 0 for x in texts], np.float64)
    counted = {
        "chars": chars, "linked": each("linked"), "tags": each("tags"), "runs": leaf,
        "words": [x.count(" ") + 1 if x else 0 for x in texts], "ends": [len(_END.findall(x)) if x else 0 for x in texts],
        "commas": [x.count(",") if x else 0 for x in texts], "digits": [sum(map(str.isdigit, x[:400])) if x else 0 for x in texts],
        "signs": [sum(map(x.count, "©|»·")) if x else 0 for x in texts],
    }
    total = {}
    for name, values in counted.items():
        sums = np.concatenate([[0.0], np.cumsum(np.asarray(values, np.float64))])
        total[name] = sums[stop] - sums[index]
    size = np.maximum(total["chars"], 1)
    page = total["chars"][first]
    before = np.concatenate([[0.0], np.cumsum(chars)])[index] - np.concatenate([[0.0], np.cumsum(chars)])[first]
    # A node's next sibling starts where it stops, the one before stops where it starts.
    following = np.where((stop < stop[up]) & ~top, np.minimum(stop, n - 1), -1)
    preceding = np.full(n, -1)
    preceding[following[following >= 0]] = index[following >= 0]
    links = total["linked"] / size
    beside = lambda values, at: np.where(at >= 0, values[at], 0.0)
    kind, names = each("kind"), each("names")
    siblings = np.bincount(up[~top], minlength=n).astype(np.float64)
    alike = np.zeros(n)
    both = up * 64 + kind
    _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
    alike[:] = count[inverse]
    # What stands above a node: names of parts and kinds of elements, from the top down.
    above = names | each("hidden") << 12 | np.where(leaf, 0, 1 << (kind + 13))
    order = np.argsort(each("depth"), kind="stable")
    depth = each("depth")
    cuts = np.searchsorted(depth[order], np.arange(1, (depth.max() if n else 0) + 2))
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        level = order[lo:hi]
        above[level] |= above[up[level]]
    log = lambda x: np.log1p(np.maximum(x, 0))
    words = np.maximum(total["words"], 1)
    columns = [
        log(total["chars"]), log(total["words"]), links, log(total["linked"]), total["chars"] / (total["tags"] + 1), total["chars"] / np.maximum(total["runs"], 1), log(total["runs"]),
        total["chars"] / np.maximum(page, 1), total["chars"] / np.maximum(total["chars"][up], 1), before / np.maximum(page, 1), (before + total["chars"]) / np.maximum(page, 1),
        total["ends"] / words, total["commas"] / words, total["digits"] / size, total["signs"] / words, total["chars"] / words,
        np.minimum(depth, 30), siblings[up], alike, alike / np.maximum(siblings[up], 1), beside(log(total["chars"]), preceding), beside(log(total["chars"]), following),
        beside(links, preceding), beside(links, following), links[up], log(total["chars"][up]), total["chars"][up] / np.maximum(total["runs"][up], 1), leaf, log(page),
        *(kind == k for k in range(len(_KINDS) + 1)), *(kind[up] == k for k in range(len(_KINDS) + 1)),
        *(names >> k & 1 for k in range(len(_NAMED))), *(above >> k & 1 for k in range(13)), *(above >> k & 1 for k in range(14, 14 + len(_KINDS))),
    ]
    return np.stack([np.asarray(c, np.float32) for c in columns], 1)


def choose(tree: Tree, odds) -> list[bool]:
    """Which nodes hold main text, given the log odds of each.

    Nothing is chosen below a node that is not, so no descendant contradicts an ancestor. Of
    all choices of that kind the one of the greatest sum is taken, from the leaves up.
    """
    gain, best = [float(x) for x in odds], [0.0] * len(tree.parent)
    for i in range(len(gain) - 1, -1, -1):
        best[i] = gain[i] if gain[i] > 0 else 0.0
        up = tree.parent[i]
        if up >= 0:
            gain[up] += best[i]
    chosen = []
    for i, up in enumerate(tree.parent):
        chosen.append(gain[i] > 0 and (up < 0 or chosen[up]))
    return chosen


# ---- training pages --------------------------------------------------------------------------


def _labelled(html: str) -> tuple[Tree, list[bool]]:
    """A page and which runs are main text, as its elements say: inside an article or main
    element, outside of parts that are named otherwise."""
    tree = Tree(html)
    article, other = {_KIND["article"], _KIND["main"]}, {_KIND[t] for t in ("nav", "aside", "footer", "header", "form")}
    apart = sum(1 << k for k, name in enumerate(_NAMED) if name != "main")
    inside, main = [], []
    for i, up in enumerate(tree.parent):
        was = inside[up] if up >= 0 else 0
        if tree.texts[i] is None:
            was = -1 if was == -1 or (tree.kind[i] in other or tree.names[i] & apart) and was else (1 if tree.kind[i] in article else was)
        inside.append(was)
        main.append(tree.texts[i] is not None and was == 1)
    return tree, main


def layouts(pages: list[str], copies: int, seed: int) -> list[tuple[Tree, list[bool]]]:
    """Pages whose main text is known: labelled pages as they are, and their texts in other
    layouts, with other elements and names, and parts that the pages may lack."""
    import random
    from html import escape

    rng, out = random.Random(seed), []
    known = [x for x in map(_labelled, pages) if any(x[1])]
    body = [[t.texts[i] for i, y in enumerate(main) if y] for t, main in known]
    rest = [t.texts[i] for t, main in known for i, y in enumerate(main) if not y and t.texts[i]] or ["Home", "About"]
    prose = [p for b in body for p in b]
    pick = lambda *options: rng.choice(options)

    def box(options: str, inner: str, plain: bool) -> str:
        tag, *name = pick(*options.split("|")).split(".")
        name = "" if not name or plain else f' {pick("class", "class", "id")}="{pick("", "site-", "l-", "x ")}{name[0]}"'
        return f"<{'div' if plain and tag in _KIND and tag not in 'ul li p table tr td h3' and rng.random() < 0.6 else tag}{name}>{inner}</{tag}>"

    short = lambda: escape(" ".join(rng.choice(rest).split()[: rng.randint(1, 4)]))
    some = lambda: escape(" ".join(rng.choice(prose).split()[: rng.randint(4, 60)]))
    links = lambda lo, hi: "".join(f'<li><a href="/{k}">{short()}</a></li>' for k in range(rng.randint(lo, hi)))
    for blocks in body:
        for _ in range(copies):
            plain, maybe = rng.random() < 0.2, lambda chance: rng.random() < chance
            b = lambda options, inner: box(options, inner, plain)
            head = b("header|div.header|div.masthead|section.topbar", (f"<p>{short()}</p>" if maybe(0.5) else "") + b("nav|div.menu|div.navbar|nav.navigation", f"<ul>{links(3, 12)}</ul>"))
            if maybe(0.3):
                head = b("nav|div.menu|ul.nav", links(3, 12)) + head * maybe(0.5)
            notice = b("div.cookie|div.notice|section.consent|div.popup|dialog.modal", f"<p>{some()}</p><a href='/p'>{short()}</a>") * maybe(0.4)
            ad = lambda: b("div.ad|aside.promo|div.ads|div.advert|section.sponsored", pick(f"<p>{some()}</p>", some(), f"<a href='/x'>{short()}</a> {some()}"))
            form = lambda: b("form|form.search|div.newsletter|form.login", f"<label>{short()}</label><p>{some()}</p><input name='q'><button>Go</button>")
            more = lambda: b("div.related|aside.more|section.related|div.share|div.links", f"<h3>{short()}</h3><ul>{links(3, 8)}</ul>")
            side = b("aside|div.sidebar|div.widget|section.side|aside.rail", "".join(pick(more, ad, form, lambda: f"<h3>{short()}</h3><p>{some()}</p>")() for _ in range(rng.randint(1, 4)))) * maybe(0.6)
            talk = ""
            if maybe(0.6):
                each = "".join(b("div.comment|li.comment|article.comment|div.reply", f"<p><b>{short()}</b></p><p>{some()}</p>" if maybe(0.6) else f"<p>{some()}</p>") for _ in range(rng.randint(1, 6)))
                talk = b("section.comments|div.comments|ol.commentlist|div.discussion|div.replies", f"<h3>{short()}</h3>{each}" + form() * maybe(0.4))
            wrap = pick("<p>{}</p>", "<p>{}", "<div>{}</div>", "{}<br><p></p>", "<p><span>{}</span></p>")
            parts = []
            for k, text in enumerate(blocks):
                shape = "<h1>{}</h1>" if k == 0 and maybe(0.7) else pick("<h2>{}</h2>", "<ul><li>{}</li></ul>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</td></tr></table>") if maybe(0.06) else wrap
                words = escape(text).split(" ")
                if maybe(0.2) and len(words) > 6:
                    words[2] = pick(f"<a href='/k'>{words[2]}</a>", f"<b>{words[2]}</b>", f"<em>{words[2]}</em>")
                parts.append(shape.format(_MARK + " ".join(words)))
                if k and maybe(0.06):
                    parts.append(pick(ad, more)())
            inner = "".join(parts)
            inside = pick("", "", more(), talk)
            main = b("article|main|div.post|div.entry|div.content|section.story|div.article|article.post|div|section", inner + inside)
            if maybe(0.4):
                main = b("main|div.content|div.main|section|div.page", pick(side, "") + main + more() * maybe(0.3))
            talk = "" if inside == talk else talk
            foot = b("footer|div.footer|footer.bottom|div.copyright", pick(f"&copy; {short()} &middot; {some()}", f"<p>&copy; {short()}</p><ul>{links(2, 8)}</ul>"))
            order = [notice, head, ad() * maybe(0.4), pick(side + main, main + side), talk, more() * maybe(0.3), form() * maybe(0.2), foot, notice * maybe(0.1)]
            tree = Tree("<!DOCTYPE html><html><body>" + b("div|div.wrapper|div.page", "".join(order)) + "</body></html>")
            out.append((tree, [x is not None and _MARK in x for x in tree.texts]))
    return known + out


def training_rows(pages: DataFrame, html_col: str, max_pages: int, copies: int, seed: int) -> DataFrame:
    """``label, features`` of the nodes of training pages: 1 for nodes that hold main text."""

    def run(frames):
        import numpy as np
        import pandas as pd

        for frame in frames:
            found = layouts([h or "" for h in frame["html"]], copies, seed)
            if not found:
                continue
            labels = []
            for tree, main in found:
                holds = [float(y) for y in main]
                for i in range(len(holds) - 1, 0, -1):
                    holds[tree.parent[i]] = max(holds[tree.parent[i]], holds[i])
                labels += holds
            yield pd.DataFrame({"label": np.array(labels), "features": list(features([t for t, _ in found]).astype(np.float64))})

    marked = pages.where(F.lower(html_col).rlike("<(article|main)[\\s>]")).select(F.col(html_col).alias("html"))
    drawn = marked.orderBy(F.xxhash64(F.lit(seed), "html"), "html").limit(max_pages)
    # Texts of one layout come from pages of the same piece.
    return drawn.repartition(4, F.xxhash64("html")).mapInPandas(run, "label double, features array<double>")


class Trees:
    """Boosted trees as arrays: the sum of their leaves is half the log odds."""

    def __init__(self, trees: list[tuple[float, list[tuple]]]):
        self.trees = trees

    def odds(self, rows):
        import numpy as np

        total = np.zeros(len(rows))
        for weight, nodes in self.trees:
            feature, least, left, right, value = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(rows), np.int64)
            while True:
                open_ = np.flatnonzero(feature[at] >= 0)
                if not len(open_):
                    break
                node = at[open_]
                at[open_] = np.where(rows[open_, feature[node]] <= least[node], left[node], right[node])
            total += weight * value[at]
        return 2 * total


def fit(pages: DataFrame, html_col: str = "html", max_pages: int = 300, copies: int = 2, rounds: int = 30, depth: int = 5, seed: int = 13) -> Trees | None:
    """Trees fitted on at most ``max_pages`` pages that mark their article, in hash order, and
    ``copies`` other layouts of each. None where no page is marked."""
    # The sample is small: few pieces, so that the many short steps of the fit start few tasks.
    rows = steady(training_rows(pages, html_col, max_pages, copies, seed)).coalesce(4).select("label", array_to_vector("features").alias("features"))
    if rows.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, labelCol="label", stepSize=0.3).fit(rows)

    def flat(node, out):
        at = len(out)
        out.append(None)
        if node.getClass().getSimpleName() == "InternalNode":
            left, right = flat(node.leftChild(), out), flat(node.rightChild(), out)
            out[at] = (node.split().featureIndex(), node.split().threshold(), left, right, 0.0)
        else:
            out[at] = (-1, 0.0, -1, -1, node.prediction())
        return at

    trees = []
    for weight, tree in zip(model.treeWeights, model.trees):
        nodes: list[tuple] = []
        flat(tree._java_obj.rootNode(), nodes)
        trees.append((float(weight), nodes))
    return Trees(trees)


def extract(pages: DataFrame, model: Trees | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **options) -> DataFrame:
    """Per page: page_id, url, text, n_chars: the main text, blocks divided by an empty line.

    A page is read as a tree of blocks. Boosted trees give every node the odds of holding
    main text, and the best choice without contradictions between nodes and what stands above
    them is kept. Without a model one is fitted on these pages; where no page marks its
    article, runs of 80 characters and more that are mostly no links are taken for main text.
    Null and empty pages have empty text. Pages of any length take linear time and are
    one task's memory each. Repeated rows come out as often as they come in; an empty
    table gives no rows; further columns are not read.
    """
    import numpy as np

    model = model or fit(pages, html_col, **options)
    spread = pages.sparkSession.sparkContext.broadcast(model)

    def odds(rows):
        if spread.value is not None:
            return spread.value.odds(rows)
        return np.where((rows[:, 0] >= np.log1p(80)) & (rows[:, 2] < 0.5), 1.0, np.where(rows[:, 27] > 0, -1.0, -0.01))

    def run(batches):
        import pyarrow as pa

        def texts(group):
            trees = [Tree(h) for h in group]
            scores, at = odds(features(trees)), 0
            for tree in trees:
                chosen = choose(tree, scores[at : at + len(tree.parent)])
                at += len(tree.parent)
                yield "\n\n".join(t for t, y in zip(tree.texts, chosen) if y and t)

        for batch in batches:
            done, group, size = 0, [], 0
            for row, value in enumerate(batch.column(2)):
                group.append(value.as_py() or "")
                size += len(group[-1])
                if size > _GROUP or row == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(done, len(group)), batch.column(1).slice(done, len(group)), pa.array(list(texts(group)), pa.string())],
                        ["page_id", "url", "text"])
                    done, group, size = done + len(group), [], 0

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    found = rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return found.select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


@query("op13_html_extraction")
def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
