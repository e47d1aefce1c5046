"""Main text of web pages: a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text without a block-level
boundary, each with its open ancestors. Features are the ancestors' tags and the
words of their classes and ids, and the look of the text: length, share of links,
punctuation, place. The field's two labels are main text and the rest; it is
trained on labelled pages by gradient ascent on the log-likelihood and decoded by
Viterbi. The weights are a few thousand numbers and go out as a broadcast.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import parts_of, table
from textmill.llm.html_training import labelled_pages

#: Elements whose content is no text of the page, up to their own end tag.
RAW = frozenset("script style noscript template svg math iframe object canvas textarea xmp".split())
#: Of these, the ones that a slash may close at once.
FOREIGN = frozenset(["svg", "math"])
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_STOP = re.compile(r"[\s/>]")
_SPECIAL = re.compile("[>\"']")
_ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_QUOTED = re.compile("\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)", re.I)
_STYLE = re.compile(r"""\bstyle\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_TAG = re.compile("<[A-Za-z/!?]")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
#: Elements that end a leaf block. All other elements are part of the text around them.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend "
    "li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What an opening tag closes: an open element of the first set that lies above one of the second.
_ITEMS = {"li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _ITEMS.items()}


class Node:
    """An open element: its tag, and the features that it and its ancestors give to the blocks within."""

    __slots__ = ("tag", "up", "own", "_all", "score")

    def __init__(self, tag: str, up: Node | None, own: tuple[str, ...]):
        self.tag, self.up, self.own = tag, up, own
        self._all: frozenset[str] | None = None
        self.score: float | None = None

    def features(self) -> frozenset[str]:
        """Nodes that add nothing share the set of their parent, so a deep page of few names costs no more than its depth."""
        line = [self]
        while line[-1]._all is None and line[-1].up is not None:
            line.append(line[-1].up)
        have = line[-1]._all or frozenset()
        for node in reversed(line):
            if node._all is None:
                node._all = have if have.issuperset(node.own) else have.union(node.own)
            have = node._all
        return have


@dataclass(slots=True)
class Block:
    text: str
    node: Node | None
    linked: int


class _Ends:
    """Where tags end: the ``>`` after a tag's start that stands in no quotes, or -1.

    Every quote is followed once only, whatever the number of tags that begin before
    it: quotes from which no end can be reached are remembered, and starts come in order.
    """

    def __init__(self, page: str):
        self.page, self.lost, self.first = page, set(), -1

    def find(self, start: int) -> int:
        if self.first < start:
            m = _SPECIAL.search(self.page, start)
            self.first = m.start() if m else len(self.page)
        at, seen = self.first, []
        while at < len(self.page) and at not in self.lost:
            quote = self.page[at]
            if quote == ">":
                return at
            seen.append(at)
            close = self.page.find(quote, at + 1)
            m = _SPECIAL.search(self.page, close + 1) if close >= 0 else None
            at = m.start() if m else len(self.page)
        self.lost.update(seen)
        return -1


class _Open:
    """The open elements, with the places of each tag among them and of those that are not shown."""

    def __init__(self):
        self.stack: list[Node] = []
        self.where: dict[str, list[int]] = {}
        self.unseen: list[int] = []

    def push(self, node: Node, unseen: bool = False) -> None:
        if unseen:
            self.unseen.append(len(self.stack))
        self.where.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while self.unseen and self.unseen[-1] >= at:
            self.unseen.pop()
        while len(self.stack) > at:
            self.where[self.stack.pop().tag].pop()

    def last(self, names) -> int:
        """The innermost open element of some tags, or -1."""
        return max((places[-1] for places in map(self.where.get, names) if places), default=-1)

    def close(self, names, within=()) -> None:
        """End the innermost element of ``names``, unless one of ``within`` lies further in."""
        at = self.last(names)
        if at >= 0 and at >= self.last(within):
            self.cut(at)

    def has(self, name: str) -> bool:
        return bool(self.where.get(name))


def leaf_blocks(page: str | None) -> list[Block]:
    return list(scan(page))


def scan(page: str | None, known=None) -> Iterator[Block]:
    """The leaf blocks of a page in order, with decoded references and single spaces; the head and what is not shown
    are no part of the page.

    One pass over the page: every search goes on from where the last one ended, and
    what is known to be missing is not looked for again, so that no markup, however
    broken, costs more than its length. A ``<`` that begins no tag is text. With
    ``known``, only these features of ancestors are kept.
    """
    page = page or ""
    ends, opened = _Ends(page), _Open()
    parts: list[str] = []
    node: Node | None = None
    linked = 0

    def add(raw: str) -> None:
        nonlocal node, linked
        if raw and not opened.unseen and not opened.has("head"):
            text = html.unescape(raw)
            if bare := len(text.strip()):
                if node is None and opened.stack:
                    node = opened.stack[-1]
                if opened.has("a"):
                    linked += bare
            parts.append(text)

    def flush() -> Block | None:
        nonlocal parts, node, linked
        text = " ".join("".join(parts).split())
        block = Block(text, node, linked) if text else None
        parts, node, linked = [], None, 0
        return block

    at = begin = 0  # where text that is not yet added begins, where to look for the next tag
    bound, stop = False, -1  # no ">" is left; where the name of a tag ends
    while (begin := page.find("<", begin)) >= 0:
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            add(page[at:begin])
            at = begin = end + 3 if end >= 0 else len(page)
            continue
        if page.startswith(("<!", "<?"), begin):
            end = -1 if bound else page.find(">", begin + 2)
            bound = end < 0
            if end >= 0:
                add(page[at:begin])
                at = end + 1
            begin = end + 1 if end >= 0 else begin + 1
            continue
        closing = page.startswith("/", begin + 1)
        name = begin + 1 + closing
        if page[name : name + 1] not in _LETTERS:
            begin += 1
            continue
        if stop < name:
            m = _STOP.search(page, name)
            stop = m.start() if m else len(page)
        end = ends.find(stop)
        if end < 0:
            begin += 1
            continue
        add(page[at:begin])
        at = end + 1
        tag, rest = page[name:stop].lower(), page[stop:end]
        begin = at
        if tag in RAW and not closing:
            if not (tag in FOREIGN and rest.endswith("/")):
                after = _end_tag(tag).search(page, at)
                at = begin = after.end() if after else len(page)
            continue
        if tag in BLOCKS:
            if block := flush():
                yield block
        elif tag == "br":
            parts.append(" ")
        if closing:
            opened.close((tag,))
            continue
        if tag in VOID or rest.endswith("/"):
            continue
        if tag in BLOCKS:
            opened.close(("p",))
            if tag == "body":
                opened.close(("head",))
        if tag in CLOSES:
            opened.close(*CLOSES[tag])
        names = " ".join(a or b or c for a, b, c in _ATTRIBUTE.findall(rest)) if "=" in rest else ""
        own = (f"in:{tag}", *(f"name:{x.lower()}" for x in _NAME.findall(names)))
        own = own if known is None else tuple(x for x in own if x in known)
        top = opened.stack[-1] if opened.stack else None
        # An element that tells nothing new is its parent over again.
        same = top is not None and top.tag == tag and top.features().issuperset(own)
        opened.push(top if same else Node(tag, top, own), tag not in ("html", "body") and _unseen(rest))
    add(page[at:])
    if block := flush():
        yield block


def _unseen(attributes: str) -> bool:
    """Whether an element is not shown: it is ``hidden``, or its own style says so. Whole pages are shown, since scripts do it."""
    low = attributes.lower()
    if "style" in low and any(_UNSEEN.search(a or b or c) for a, b, c in _STYLE.findall(attributes)):
        return True
    return "hidden" in low and _HIDDEN.search(_QUOTED.sub('""', attributes)) is not None


@lru_cache(maxsize=None)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{name}\s*>", re.I)


def look(b: Block) -> list[str]:
    """Features of a block's own text."""
    words = b.text.count(" ") + 1
    f = ["bias", f"words:{min(words.bit_length() - 1, 7)}", f"linked:{4 * b.linked // max(len(b.text), 1)}"]
    f += [f"ends:{b.text[-1] in '.!?:;…'}", f"mark:{'©' in b.text or '|' in b.text}"]
    return f + [f"leaf:{b.node.tag}"] if b.node else f


def place(k: int, n: int) -> list[str]:
    """Features of the k-th of n blocks' place."""
    return [f"first:{k < 2}", f"last:{k >= n - 2}"]


def features(blocks: list[Block]) -> list[list[str]]:
    """Names of the features that hold for each block."""
    n = len(blocks)
    return [sorted([*look(b), *place(k, n), *(b.node.features() if b.node else ())]) for k, b in enumerate(blocks)]


class ChainField:
    """Two labels; a weight for each feature (for label 1), each pair of neighbouring labels and each first label."""

    def __init__(self, weights: dict[str, float], pairs: np.ndarray, first: np.ndarray):
        self.weights, self.pairs, self.first = weights, pairs, first

    @classmethod
    def fit(cls, pages: list[tuple[list[list[str]], list[int]]], steps: int = 150, rate: float = 0.1, ridge: float = 0.3) -> ChainField:
        names: dict[str, int] = {}
        rows, cols, length = [], [], max(len(y) for _, y in pages)
        label, mask = np.zeros((len(pages), length), int), np.zeros((len(pages), length), bool)
        for p, (feats, y) in enumerate(pages):
            label[p, : len(y)], mask[p, : len(y)] = y, True
            for t, f in enumerate(feats):
                for x in f:
                    rows.append(p * length + t)
                    cols.append(names.setdefault(x, len(names)))
        rows, cols = np.array(rows), np.array(cols)
        w = np.zeros(len(names) + 6)
        speed, size, grad_of = np.zeros_like(w), np.zeros_like(w), len(names)
        true_w = np.bincount(cols, label.ravel()[rows], len(names))
        both = mask[:, 1:]
        true_pairs = np.array([[(both & (label[:, :-1] == a) & (label[:, 1:] == b)).sum() for b in (0, 1)] for a in (0, 1)], float)
        true_first = np.array([(label[:, 0] == a).sum() for a in (0, 1)], float)
        for step in range(1, steps + 1):
            pairs, first = w[grad_of : grad_of + 4].reshape(2, 2), w[grad_of + 4 :]
            unary = np.bincount(rows, w[cols], mask.size).reshape(mask.shape)
            one, two, start = cls._marginals(unary, mask, pairs, first)
            grad = np.concatenate([true_w - np.bincount(cols, one.ravel()[rows], len(names)), (true_pairs - two).ravel(), true_first - start]) - ridge * w
            speed = 0.9 * speed + 0.1 * grad
            size = 0.999 * size + 0.001 * grad * grad
            w += rate * (speed / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.999**step)) + 1e-8)
        return cls({x: float(w[i]) for x, i in names.items()}, w[grad_of : grad_of + 4].reshape(2, 2), w[grad_of + 4 :])

    @staticmethod
    def _marginals(unary: np.ndarray, mask: np.ndarray, pairs: np.ndarray, first: np.ndarray):
        """Chances of label 1 at each place, expected counts of label pairs and of first labels, by forward and backward sums."""
        n, length = unary.shape
        score = np.stack([np.zeros_like(unary), unary], -1)
        ahead = np.zeros((n, length, 2))
        back = np.zeros((n, length, 2))
        ahead[:, 0] = first + score[:, 0]
        for t in range(1, length):
            new = np.logaddexp(ahead[:, t - 1, :1] + pairs[0], ahead[:, t - 1, 1:] + pairs[1]) + score[:, t]
            ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
        for t in range(length - 2, -1, -1):
            after = back[:, t + 1] + score[:, t + 1]
            new = np.logaddexp(after[:, :1] + pairs[:, 0], after[:, 1:] + pairs[:, 1])
            back[:, t] = np.where(mask[:, t + 1, None], new, 0.0)
        total = np.logaddexp(ahead[:, -1, 0], ahead[:, -1, 1])
        place = np.exp(ahead + back - total[:, None, None]) * mask[..., None]
        joint = np.exp(ahead[:, :-1, :, None] + pairs + (score + back)[:, 1:, None, :] - total[:, None, None, None]) * mask[:, 1:, None, None]
        return place[..., 1], joint.sum((0, 1)), place[:, 0].sum(0)

    def decode(self, feats: list[list[str]]) -> list[int]:
        """The labels that are likeliest together, for blocks with these features."""
        get = self.weights.get
        return self.viterbi([sum(get(x, 0.0) for x in f) for f in feats])

    def viterbi(self, unary: list[float]) -> list[int]:
        """The labels that are likeliest together, for blocks with these weights of label 1."""
        if not unary:
            return []
        (stay0, go1), (go0, stay1) = self.pairs.tolist()
        a, b = self.first.tolist()
        b += unary[0]
        came = bytearray()  # two bits a block: where each label comes from
        for u in unary[1:]:
            from0, from1 = a + stay0 >= b + go0, a + go1 >= b + stay1
            came.append((not from0) + 2 * (not from1))
            a, b = max(a + stay0, b + go0), max(a + go1, b + stay1) + u
        label = int(b > a)
        out = [label]
        for c in reversed(came):
            label = c >> label & 1
            out.append(label)
        return out[::-1]

    def label(self, page: str | None) -> tuple[list[str], list[int]]:
        """Texts of a page's blocks and their labels; only the texts and a number a block are kept."""
        get = self.weights.get
        texts, unary = [], []
        for b in scan(page, self.weights):
            node, above = b.node, 0.0
            if node is not None:
                if node.score is None:
                    node.score = sum(get(x, 0.0) for x in sorted(node.features()))
                above = node.score
            texts.append(b.text)
            unary.append(above + sum(get(x, 0.0) for x in look(b)))
        for k in {*range(min(2, len(unary))), *range(max(0, len(unary) - 2), len(unary))}:
            unary[k] += sum(get(x, 0.0) for x in place(k, len(unary)))
        inner = sum(get(x, 0.0) for x in ("first:False", "last:False"))
        for k in range(2, len(unary) - 2):
            unary[k] += inner
        return texts, self.viterbi(unary)


@lru_cache(maxsize=2)
def default_model(pages: int = 400, seed: int = 1) -> ChainField:
    """The field trained on generated labelled pages of many layouts; the number of pages bounds the training."""
    data = []
    for page, main in labelled_pages(pages, seed):
        blocks = leaf_blocks(page)
        data.append((features(blocks), [int(b.text in main) for b in blocks]))
    return ChainField.fit(data)


def main_text(model: ChainField, page: str | None) -> str:
    """The main text of a page; all of one that has no markup at all."""
    if page and not _TAG.search(page):
        return " ".join(html.unescape(page).split())
    texts, labels = model.label(page)
    return "\n".join(x for x, y in zip(texts, labels, strict=True) if y)


def extract_main_text(pages: DataFrame, model: ChainField | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: ``page_id, url, text, n_chars``.

    A null or empty page, and one without main text, gives an empty text. Pages are
    read whole, null and repeated ids stay, other columns are ignored.
    """
    sent = pages.sparkSession.sparkContext.broadcast(model or default_model())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches, "html"):
            texts = [main_text(sent.value, x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))
