"""Main text of the pages behind the links of alerts: a linear-chain conditional random field over DOM leaf blocks."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.page_layouts import MAIN, labelled_pages
from terravane.llm.texts import small_batches, text_of

SENTENCE_PAGES = 200
# A comment, a declaration, a tag with its attributes.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
# Fixed values of the document format: elements by what they do to the text.
RAW = ("script", "style", "textarea", "iframe", "noembed", "noframes", "xmp", "template", "svg", "math", "object")
UNSEEN = ("title", "noscript", "select", "button", "datalist", "audio", "video", "canvas")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
IMPLIED_END = {
    "p": frozenset({"p"}), "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}), "tr": frozenset({"tr", "td", "th"}),
    "td": frozenset({"td", "th"}), "th": frozenset({"td", "th"}), "option": frozenset({"option"}),
}
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
WORD_PART = re.compile(r"[a-z]+")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """Leaf blocks in page order: ancestors from the root down (``tag.class...``), text with one space for white space, letters in links.

    Character references are decoded, scripts, styles and comments left out.  Tags that are not closed end where the
    format says; a page cut short ends all.
    """
    out: list[tuple[tuple[str, ...], str, int]] = []
    stack: list[tuple[str, str]] = [("", "")]
    parts: list[str] = []
    linked, unseen, links = 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append((tuple(s for _, s in stack if s), text, linked))
            parts.clear()
        linked = 0

    def close(name: str, stop: frozenset = frozenset(("table", "td", "th", "ul", "ol"))) -> None:
        """End the nearest open element of that name, and all inside it; not beyond ``stop`` for implied ends."""
        nonlocal unseen, links
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                for tag, _ in stack[i:]:
                    unseen -= tag in UNSEEN
                    links -= tag == "a"
                del stack[i:]
                return
            if stack[i][0] in stop:
                return

    at, end = 0, len(page)
    while at < end:
        m = TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not unseen:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                parts.append(" ")
                continue
            if name not in INLINE:
                flush()
            close(name, frozenset())
            continue
        if name in RAW:
            stop = RAW_END[name].search(page, at)
            if not m[3].rstrip().endswith("/"):
                at = stop.end() if stop else end
            if name not in INLINE:
                flush()
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in INLINE:
            flush()
            if name in CLOSES_P:
                close("p")
            for other in IMPLIED_END.get(name, ()):
                if other != "p":
                    close(other, frozenset(("table",)) if name in ("td", "th", "tr") else frozenset(("ul", "ol", "dl", "table")))
        if name in VOID or m[3].endswith("/"):
            continue
        if name in INLINE and name != "a":
            continue
        said = "".join("." + v.lower() for a in ATTRIBUTE.finditer(m[3]) for v in ((a[2] or a[3] or a[4] or "").split()))
        stack.append((name, name + said))
        unseen += name in UNSEEN
        links += name == "a"
    flush()
    return out


def _steps(n: int, *bounds: int) -> int:
    return sum(n >= b for b in bounds)


def path_features(path: tuple[str, ...]) -> list[str]:
    """The tag, the words in names of ancestors, and those of the innermost and the outer ones apart."""
    out = {"tag:" + (path[-1].split(".")[0] if path else "")}
    for depth, node in enumerate(reversed(path)):
        tag, *names = node.split(".")
        out.add("in:" + tag)
        for name in names:
            out.update("name:" + w for w in WORD_PART.findall(name))
            out.add("full:" + name)
    return sorted(out)


def text_features(text: str, linked: int) -> list[str]:
    n = len(text)
    words = text.count(" ") + 1
    return [f"len{_steps(words, 3, 6, 12, 25, 50)}", f"link{_steps(100 * linked // max(n, 1), 1, 30, 70)}", f"end{text[-1:] in '.!?…'}", f"mark{'©' in text}", f"bar{'|' in text or '·' in text}"]


class Field:
    """Weights of the features for 'main', and of the four transitions; decoded by Viterbi."""

    def __init__(self, weights: dict[str, float], step):
        self.weights, self.step, self.paths = weights, step, {}

    def unary(self, path, text: str, linked: int) -> float:
        got = self.paths.get(path)
        if got is None:
            if len(self.paths) > 50_000:
                self.paths.clear()
            got = self.paths[path] = sum(self.weights.get(f, 0.0) for f in path_features(path))
        return got + sum(self.weights.get(f, 0.0) for f in text_features(text, linked)) + self.weights.get("bias", 0.0)

    def decode(self, found) -> list[bool]:
        """Most likely labels of the blocks of a page."""
        back: list[tuple[int, int]] = []
        (oo, om), (mo, mm) = self.step
        other, main = 0.0, 0.0
        for i, (path, text, linked) in enumerate(found):
            u = self.unary(path, text, linked)
            if i == 0:
                other, main = 0.0, u
                back.append((0, 0))
                continue
            a = (other + oo, 0) if other + oo >= main + mo else (main + mo, 1)
            b = (other + om, 0) if other + om >= main + mm else (main + mm, 1)
            back.append((a[1], b[1]))
            other, main = a[0], b[0] + u
        label = int(main > other)
        out = []
        for pair in reversed(back):
            out.append(bool(label))
            label = pair[label]
        return out[::-1]


def train_field(pages: list[str], steps: int = 400, ridge: float = 0.05) -> Field:
    """Maximum likelihood with ridge by forward-backward sums; labels are the marks of :mod:`page_layouts`."""
    import numpy as np

    names: dict[str, int] = {"bias": 0}
    sequences = []
    for page in pages:
        rows, labels = [], []
        for path, text, linked in blocks(page):
            labels.append(int(MAIN in text))
            text = SPACE.sub(" ", text.replace(MAIN, "")).strip()
            rows.append([0, *(names.setdefault(f, len(names)) for f in [*path_features(path), *text_features(text, linked)])])
        if rows:
            sequences.append((rows, np.array(labels)))
    width = max((len(r) for rows, _ in sequences for r in rows), default=1)
    longest = max((len(rows) for rows, _ in sequences), default=1)
    count = len(sequences)
    # All pages side by side, padded: place 0 of the weights is a dummy that stays 0.
    idx = np.zeros((count, longest, width), dtype=np.int64)
    y = np.zeros((count, longest), dtype=np.int64)
    real = np.zeros((count, longest), dtype=bool)
    for i, (rows, labels) in enumerate(sequences):
        for j, r in enumerate(rows):
            idx[i, j, : len(r)] = np.array(r) + 1
        y[i, : len(rows)], real[i, : len(rows)] = labels, True
    w, trans = np.zeros(len(names) + 1), np.zeros((2, 2))
    gw, gt = np.full_like(w, 1e-2), np.full_like(trans, 1e-2)
    for _ in range(steps):
        u = np.zeros((count, longest, 2))
        u[:, :, 1] = w[idx].sum(2)
        alpha, beta = np.zeros_like(u), np.zeros_like(u)
        alpha[:, 0] = u[:, 0]
        for t in range(1, longest):
            z = alpha[:, t - 1, :, None] + trans
            a = np.logaddexp(z[:, 0], z[:, 1]) + u[:, t]
            alpha[:, t] = np.where(real[:, t, None], a, alpha[:, t - 1])
        for t in range(longest - 2, -1, -1):
            z = trans + (u[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(real[:, t + 1, None], np.logaddexp(z[:, :, 0], z[:, :, 1]), 0.0)
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
        p = np.exp(alpha + beta - total[:, None, None]) * real[:, :, None]
        residual = np.where(real, p[:, :, 1] - (y == 1), 0.0)
        g = np.bincount(idx.ravel(), weights=np.repeat(residual.ravel(), width), minlength=len(w)) / count + ridge * w / len(w) ** 0.5
        g[0] = 0.0
        both = real[:, 1:]
        pair = np.exp(alpha[:, :-1, :, None] + trans + (u[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][both], y[:, 1:][both]), 1.0)
        gtr = (pair.sum((0, 1)) - seen) / count + ridge * trans
        gw += g * g
        gt += gtr * gtr
        w -= 0.3 * g / np.sqrt(gw)
        trans -= 0.3 * gtr / np.sqrt(gt)
    return Field({f: float(w[i + 1]) for f, i in names.items()}, tuple(map(tuple, trans.tolist())))


def main_text(page: str, field: Field) -> str:
    """Blocks labelled main, one per line."""
    found = blocks(page)
    return "\n".join(text for (_, text, _), keep in zip(found, field.decode(found)) if keep)


def extract_pages(pages: DataFrame, page_id: str = "page_id", link: str = "link", html_text: str = "html", sentence_pages: int = SENTENCE_PAGES) -> DataFrame:
    """Main text of every whole page.

    The project keeps links of alerts but no pages, so ``pages(page_id, link, html)`` is the record of a page behind a link.  The field
    is trained on labelled layouts filled with texts of at most ``sentence_pages`` of the given pages.  Returns one row per row:
    ``page_id, link, text``.  NULL or empty html gives the empty text; broken html is read as far as it goes; repeated rows
    get equal texts; an empty table gives an empty table; other columns are ignored.
    """
    import pyarrow as pa

    small_batches(pages.sparkSession, 256)
    base = pages.select(F.col(page_id).alias("page_id"), F.col(link).alias("link"), text_of(html_text).alias("html"))
    # First only hashes go to the driver, then the pages of the smallest ones: some megabytes, however many partitions there are.
    hashed = base.filter(F.length("html") > 0).select("html", F.xxhash64("page_id").alias("h"), F.xxhash64("html").alias("g"))
    least = hashed.select("h", "g").distinct().orderBy("h", "g").limit(sentence_pages).collect()
    last = least[-1] if least else (0, 0)
    chosen = hashed.filter((F.col("h") < last[0]) | ((F.col("h") == last[0]) & (F.col("g") <= last[1])))
    samples = [r["html"] for r in chosen.groupBy("h", "g").agg(F.first(F.substring("html", 1, 20_000)).alias("html")).collect()] if least else []
    sentences = sorted({t for page in samples for _, t, _ in blocks(page) if 20 < len(t) < 2000})
    field = train_field(labelled_pages(sentences))
    kinds = [base.schema[c].dataType.simpleString() for c in ("page_id", "link")]

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, field) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("link"), pa.array(texts, pa.string())], ["page_id", "link", "text"])

    return base.mapInArrow(extracted, f"page_id {kinds[0]}, link {kinds[1]}, text string")
