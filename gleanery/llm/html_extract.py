"""Main text of web pages by a tree-structured graphical model.

The nodes are a page's block elements and the runs of text in them; each is
content or not. A node's potential comes from its own features (tag, class and
id words, text length, share of links, sentence ends; of a text run also the
tags and words around it), an edge's from how often
parent and child agree. Sum-product messages, upward and then downward, give
every node's marginal exactly, as the graph is a tree; text runs with a
marginal over one half are the main text. Both kinds of potentials are trained
on labelled pages.
"""

from __future__ import annotations

import html
import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_bounds
from .html_pages import labelled_pages

TRAINING_PAGES = 1000
#: Most features that a text run has of the elements around its parent.
ABOVE = 24

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"""
    r"""|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
NAME = re.compile(r"""\b(class|id|role|data-main)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE_END = re.compile(r"[.!?…。！？](?:\s|$)")
#: HTML's elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("script style noscript template head title svg math iframe object canvas audio video textarea".split())
#: What such an element holds is no markup; unclosed, it takes the rest of the page.
RAW = frozenset("script style iframe textarea".split())
END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I | re.A) for tag in UNSEEN}
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br input nobr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: An opening tag ends these open siblings, up to the given containers.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Tree:
    """Nodes in page order, parents before children. A text run has the tag '#'."""

    def __init__(self, page: str):
        self.tags, self.parents, self.names, self.marks = ["#root"], [-1], [""], [False]
        self.texts, self.linked, self.ends = [""], [0], [0]
        self._stack, self._run, self._link, self._linked = [0], [], False, 0
        self._read(page)

    def _read(self, page: str) -> None:
        at, unclosed = 0, set()
        while (m := TOKEN.search(page, at)) is not None:
            if m.start() > at:
                self._text(page[at : m.start()])
            at = m.end()
            closing, opening = m[1], m[2] or m[4]
            if closing:
                self._close(closing.lower())
            elif opening:
                tag, attributes = opening.lower(), m[3] or m[5] or ""
                if tag in UNSEEN:
                    if not attributes.endswith("/") and tag not in unclosed:
                        end = END[tag].search(page, at)
                        if end:
                            at = end.start()
                        elif tag in RAW:
                            at = len(page)
                        else:
                            unclosed.add(tag)
                else:
                    self._open(tag, attributes)
        if at < len(page):
            self._text(page[at:])
        self._flush()

    def _text(self, raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        self._run.append(text)
        if self._link:
            self._linked += len(text)

    def _add(self, tag: str, name: str, mark: bool, text: str = "") -> int:
        self.tags.append(tag)
        self.parents.append(self._stack[-1])
        self.names.append(name)
        self.marks.append(mark)
        self.texts.append(text)
        self.linked.append(self._linked if text else 0)
        self.ends.append(len(SENTENCE_END.findall(text)) if text else 0)
        return len(self.tags) - 1

    def _flush(self) -> None:
        """Ends the run of text before a block begins or ends."""
        text = " ".join("".join(self._run).split())
        if text:
            self._add("#", "", self.marks[self._stack[-1]], text)
        self._run, self._linked = [], 0

    def _open(self, tag: str, attributes: str) -> None:
        if tag in INLINE:
            if tag == "br":
                self._run.append(" ")
            elif tag == "a":
                self._link = True
            return
        self._flush()
        self._link = False
        stack, tags = self._stack, self.tags
        if tag in CLOSES_P and tags[stack[-1]] == "p":
            stack.pop()
        if tag in SIBLINGS:
            ended, within = SIBLINGS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if tags[stack[i]] in within:
                    break
                if tags[stack[i]] in ended:
                    del stack[i:]
                    break
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in NAME.finditer(attributes)} if "=" in attributes else {}
        node = self._add(tag, " ".join(filter(None, (found.get(k) for k in ("class", "id", "role")))), "data-main" in found)
        if tag not in VOID and not attributes.endswith("/"):
            stack.append(node)

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._link = False
            return
        for i in range(len(self._stack) - 1, 0, -1):
            if self.tags[self._stack[i]] == tag:
                self._flush()
                self._link = False
                del self._stack[i:]
                return

    def sums(self) -> tuple[list[int], list[int], list[int]]:
        """Length of the text, of its links, and sentence ends, below each node."""
        length, linked, ends = [len(t) for t in self.texts], self.linked.copy(), self.ends.copy()
        for i in range(len(self.tags) - 1, 0, -1):
            p = self.parents[i]
            length[p] += length[i]
            linked[p] += linked[i]
            ends[p] += ends[i]
        return length, linked, ends


@lru_cache(50_000)
def name_words(name: str) -> tuple[str, ...]:
    return tuple(dict.fromkeys("name=" + w.lower() for w in PART.findall(name)))


def above(tree: Tree) -> list[tuple[str, ...]]:
    """Tags and name words of the elements around each node but its parent, the nearest first, ABOVE at most."""
    found: list[tuple[str, ...]] = []
    for i, p in enumerate(tree.parents):
        if i == 0 or p == 0:
            found.append(())
            continue
        # what is around the parent, and the parent's own parent
        g = tree.parents[p]
        own = ("above " + tree.tags[g], *("above " + w for w in name_words(tree.names[g])))
        before = found[p]
        found.append(before if all(w in before for w in own) else tuple(dict.fromkeys(own + before))[:ABOVE])
    return found


def features(tree: Tree) -> list[list[str]]:
    length, linked, ends = tree.sums()
    around = above(tree)
    found = []
    for i, tag in enumerate(tree.tags):
        n = length[i]
        share = 4 * linked[i] // n if n else -1
        if tag == "#":
            own = ["run", f"run in {tree.tags[tree.parents[i]]}", f"run of {n.bit_length()}", f"run links {share}", "run sentence" if ends[i] else "run no sentence"]
            own += ["in " + w for w in name_words(tree.names[tree.parents[i]])]
            own += around[i]
            if "©" in tree.texts[i]:
                own.append("run marks")
        else:
            own = ["element", f"tag {tag}", f"links {share}", f"length {n.bit_length()}", f"ends {min(ends[i], 8)}", *name_words(tree.names[i])]
        found.append(own)
    return found


class Model:
    def __init__(self, weights: dict[str, float], agree: dict[bool, tuple[tuple[float, float], tuple[float, float]]]):
        self.weights = weights
        #: is a text run -> [parent's state][child's state]
        self.agree = agree

    def marginals(self, tree: Tree) -> list[float]:
        """Sum-product over the tree, in log odds of being content."""
        get, log, exp = self.weights.get, math.log, math.exp
        up = [sum([get(f, 0.0) for f in own]) for own in features(tree)]
        parents, n = tree.parents, len(up)
        tables = [self.agree[t == "#"] for t in tree.tags]
        sent = [0.0] * n
        for i in range(n - 1, 0, -1):
            (a, b), (c, d) = tables[i]
            e = exp(max(-40.0, min(40.0, up[i])))
            sent[i] = log((d * e + c) / (b * e + a))
            up[parents[i]] += sent[i]
        total = up
        for i in range(1, n):
            (a, b), (c, d) = tables[i]
            e = exp(max(-40.0, min(40.0, total[parents[i]] - sent[i])))
            total[i] = up[i] + log((d * e + b) / (c * e + a))
        return [1 / (1 + exp(-max(-40.0, min(40.0, x)))) for x in total]

    def blocks(self, page: str) -> list[tuple[str, float]]:
        """Each text run with its marginal."""
        tree = Tree(page)
        found = self.marginals(tree)
        return [(t, found[i]) for i, t in enumerate(tree.texts) if tree.tags[i] == "#"]

    def main_text(self, page: str) -> str:
        return "\n\n".join(t for t, p in self.blocks(page) if p > 0.5)


def train(pages: list[str], steps: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> Model:
    """Fits logistic node potentials and counts how parent and child agree.

    Labels are the pages' data-main marks; an element is content if most of its
    text is. Edge potentials are the pair's frequency over what independent
    states would give, so that node potentials are not counted twice.
    """
    rows, labels, pairs = [], [], {True: np.ones((2, 2)), False: np.ones((2, 2))}
    for page in pages:
        tree = Tree(page)
        n = len(tree.tags)
        whole = [len(t) for t in tree.texts]
        good = [w if m else 0 for w, m in zip(whole, tree.marks)]
        for i in range(n - 1, 0, -1):
            whole[tree.parents[i]] += whole[i]
            good[tree.parents[i]] += good[i]
        state = [int(2 * g > w) for g, w in zip(good, whole)]
        own = features(tree)
        for i in range(n):
            if whole[i]:
                rows.append(own[i])
                labels.append(state[i])
                if i:
                    pairs[tree.tags[i] == "#"][state[tree.parents[i]], state[i]] += 1
    index = {f: k for k, f in enumerate(sorted({f for own in rows for f in own}))}
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns = np.array([index[f] for own in rows for f in own])
    y, w, momentum = np.array(labels, float), np.zeros(len(index)), np.zeros(len(index))
    seen = np.bincount(columns, minlength=len(w)).astype(float)
    for _ in range(steps):
        z = np.bincount(at, w[columns], len(rows))
        off = 1 / (1 + np.exp(-z)) - y
        gradient = np.bincount(columns, off[at], len(w)) / np.sqrt(seen) / math.sqrt(len(rows)) + ridge * w
        momentum = 0.9 * momentum + gradient
        w -= rate * momentum
    agree = {}
    for kind, count in pairs.items():
        joint = count / count.sum()
        ratio = joint / np.outer(joint.sum(axis=1), joint.sum(axis=0))
        agree[kind] = tuple(map(tuple, ratio.tolist()))
    return Model({f: float(w[k]) for f, k in index.items()}, agree)


@lru_cache(1)
def default_model() -> Model:
    return train(labelled_pages(TRAINING_PAGES))


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row for each row of pages.

    The main text's blocks in page order, joined by two \\n; empty if there is
    none or html is null or empty. Whole pages are read, whatever their length.
    Repeated rows are extracted each; other columns are ignored. No shuffle.
    """
    arrow_bounds(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches):
        for b in batches:
            texts = [shared.value.main_text(h) for h in b.column("html").to_pylist()]
            columns = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.record_batch([b.column("page_id"), b.column("url"), *columns], ["page_id", "url", "text", "n_chars"])

    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    return base.mapInArrow(run, "page_id long, url string, text string, n_chars long")
