"""Main text of HTML pages by a recurrent block labeller.

A page is the sequence of its leaf blocks.  A block's vector holds its hashed tag path (tags, words of class, id and role), its hashed
words, and its length and link share.  A bidirectional LSTM in numpy reads the whole sequence and labels every block as main text or
not, so a block is judged in the context of the document.

Training pages are composed from the texts of at most TRAIN_PAGES pages, those smallest by hash of page_id, in many layouts (content
and page furniture under varying tags and class names, furniture inside the article too), so the label of every block is known.

Edge cases: a null or empty page gives an empty text; pages without tags are one block; repeated rows give repeated results; broken
markup is read as far as it goes; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blocks import Leaf, leaves
from .common import query, table, whole_text

TRAIN_PAGES = 160
COMPOSED = 448
PATH_SLOTS = 256
WORD_SLOTS = 32
MEMO_WORDS = 1 << 18
HIDDEN = 12
EPOCHS = 9
BATCH = 32
WIDTH = PATH_SLOTS + WORD_SLOTS + 4

CONTENT = ["article", "main", "div.content", "div#content", "div.post-body", "div.entry-content", "section.story", "div.article-body", "div.main-text", "article.post", "div#main"]
FURNITURE = {
    "menu": ["nav", "div.menu", "ul.nav", "div.navbar", "div#navigation", "menu", "div.breadcrumb", "div.pagination", "nav.main-nav", "div.toc"],
    "header": ["header", "div.header", "div#masthead", "div.site-header", "div.topbar"],
    "footer": ["footer", "div.footer", "div#footer", "div.copyright", "div.legal", "div.site-footer"],
    "side": ["aside", "div.sidebar", "div#sidebar", "div.related", "div.widget", "div.recommended", "aside.teaser"],
    "notice": ["div.notice", "div.cookie", "div.cookie-banner", "div.consent", "div.popup", "div.alert", "div.disclaimer", "dialog", "div.paywall", "div.gdpr"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.banner", "div.promo", "div.sponsored", "div.adbox", "section.ad", "div.sponsor"],
    "form": ["form", "div.newsletter", "div.subscribe", "form.search", "div.login", "form#signup"],
    "comments": ["section.comments", "div#comments", "div.comment", "ol.comment-list", "div.comments-area", "div.replies", "div.disqus", "div.discussion", "ul.responses"],
    "share": ["div.share", "div.social", "ul.share-links", "div.tags", "div.byline"],
}


class _Slots(dict):
    """Slot of each word met; a table of MEMO_WORDS words is started anew when full."""

    def __missing__(self, word: str) -> int:
        if len(self) > MEMO_WORDS:
            self.clear()
        slot = self[word] = zlib.crc32(word.encode()) % WORD_SLOTS
        return slot


_SLOTS = _Slots()


@lru_cache(maxsize=4096)
def _path_slots(path: tuple[tuple[str, ...], ...]) -> np.ndarray:
    return np.array(sorted({zlib.crc32(name.encode()) % PATH_SLOTS for element in path for name in element}), np.int64)


def vectors(page: list[Leaf]) -> np.ndarray:
    out = np.zeros((len(page), WIDTH), np.float32)
    for row, leaf in zip(out, page, strict=True):
        row[_path_slots(leaf.path)] = 1.0
        words = leaf.text.lower().split()
        slots = np.bincount(np.fromiter(map(_SLOTS.__getitem__, words), np.int64, len(words)), minlength=WORD_SLOTS)
        row[PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = slots / max(1, len(words))
        chars = len(leaf.text)
        row[-4:] = (np.log1p(len(words)) / 5, leaf.link_chars / chars, leaf.text[-1] in ".!?", len(leaf.path) / 10)
    return out


@dataclass
class Labeller:
    """Weights of the two directions (input, recurrent, bias) and of the output."""

    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(seed: int = 11) -> Labeller:
        rng = np.random.default_rng(seed)
        w = {"skip": np.zeros(WIDTH), "out": rng.normal(0, 0.3, 2 * HIDDEN), "shift": np.zeros(1)}
        for side in "fb":
            w |= {f"in_{side}": rng.normal(0, 0.1, (WIDTH, 4 * HIDDEN)), f"re_{side}": rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN)), f"bias_{side}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN)}
        return Labeller({k: v.astype(np.float32) for k, v in w.items()})

    def forward(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, dict]:
        """Logits of (pages, blocks); padding keeps the state at zero or as it was."""
        w, pages, steps = self.weights, *x.shape[:2]
        kept: dict = {}
        states = []
        for side in "fb":
            given = x @ w[f"in_{side}"] + w[f"bias_{side}"]
            h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
            all_h = np.zeros((pages, steps, HIDDEN), np.float32)
            trail = []
            for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
                z = given[:, t] + h @ w[f"re_{side}"]
                gates = 1 / (1 + np.exp(-z[:, : 3 * HIDDEN]))
                i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
                g = np.tanh(z[:, 3 * HIDDEN :])
                m = mask[:, t : t + 1]
                new_c = m * (f * c + i * g) + (1 - m) * c
                tanh_c = np.tanh(new_c)
                new_h = m * (o * tanh_c) + (1 - m) * h
                trail.append((t, i, f, o, g, c, tanh_c, h))
                h, c = new_h, new_c
                all_h[:, t] = h
            kept[side] = trail
            states.append(all_h)
        both = np.concatenate(states, axis=2)
        kept["both"] = both
        return both @ w["out"] + x @ w["skip"] + w["shift"][0], kept

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        w = self.weights
        logits, kept = self.forward(x, mask)
        d = (1 / (1 + np.exp(-logits)) - labels) * mask / mask.sum()
        grads = {"out": np.einsum("pt,pth->h", d, kept["both"]), "skip": np.einsum("pt,ptw->w", d, x), "shift": d.sum(keepdims=True)[0, :1]}
        for k, side in enumerate("fb"):
            into = d[:, :, None] * w["out"][k * HIDDEN : (k + 1) * HIDDEN]
            dz_all = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
            d_re = np.zeros_like(w[f"re_{side}"])
            dh_next, dc_next = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
            for t, i, f, o, g, c_before, tanh_c, h_before in reversed(kept[side]):
                m = mask[:, t : t + 1]
                dh = into[:, t] + dh_next
                active = m * dh
                dc = dc_next + active * o * (1 - tanh_c**2)
                inner = m * dc
                dz = np.concatenate((inner * g * i * (1 - i), inner * c_before * f * (1 - f), active * tanh_c * o * (1 - o), inner * i * (1 - g**2)), axis=1)
                dz_all[:, t] = dz
                d_re += h_before.T @ dz
                dh_next = dz @ w[f"re_{side}"].T + (1 - m) * dh
                dc_next = inner * f + (1 - m) * dc_next
            grads[f"in_{side}"] = np.einsum("ptw,ptg->wg", x, dz_all, optimize=True)
            grads[f"re_{side}"], grads[f"bias_{side}"] = d_re, dz_all.sum(axis=(0, 1))
        return grads


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((len(pages), steps, WIDTH), np.float32), np.zeros((len(pages), steps), np.float32)
    for i, p in enumerate(pages):
        x[i, : len(p)], mask[i, : len(p)] = p, 1
    return x, mask


def trained(examples: list[tuple[np.ndarray, np.ndarray]], seed: int = 11) -> Labeller:
    """Adam over batches of pages of similar length."""
    model, rng = Labeller.fresh(seed), np.random.default_rng(seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.weights.items()}
    order = sorted(range(len(examples)), key=lambda i: len(examples[i][0]))
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    step = 0
    for _ in range(EPOCHS):
        for b in rng.permutation(len(batches)):
            x, mask = _padded([examples[i][0] for i in batches[b]])
            labels = np.zeros_like(mask)
            for row, i in zip(labels, batches[b], strict=True):
                row[: len(examples[i][1])] = examples[i][1]
            step += 1
            for name, grad in model.gradients(x, mask, labels).items():
                first, second = moments[name]
                first += 0.1 * (grad - first)
                second += 0.001 * (grad**2 - second)
                model.weights[name] -= 0.02 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return model


def _opened(spec: str) -> tuple[str, str]:
    tag = spec.split(".")[0].split("#")[0]
    attribute = f' class="{spec.split(".")[1]}"' if "." in spec else f' id="{spec.split("#")[1]}"' if "#" in spec else ""
    return f"<{tag}{attribute}>", f"</{tag}>"


def composed(sentences: list[str], rng: np.random.Generator) -> tuple[list[Leaf], np.ndarray]:
    """A page of known structure: every main block's text starts with a mark that is taken off again."""
    mark = "\x01"

    def text(low: int, high: int) -> str:
        return " ".join(sentences[rng.integers(len(sentences))] for _ in range(rng.integers(low, high)))

    def short() -> str:
        return " ".join(text(1, 2).split()[: rng.integers(1, 9)])

    def furniture(kind: str) -> str:
        start, end = _opened(FURNITURE[kind][rng.integers(len(FURNITURE[kind]))])
        n = rng.integers(1, 6)
        if kind in ("menu", "share"):
            inner = "".join(f'<li><a href="#">{short()}</a></li>' for _ in range(n))
            inner = inner if start.startswith(("<ul", "<menu")) else f"<ul>{inner}</ul>"
        elif kind == "form":
            inner = f"<label>{short()}</label><input name=q><button>{short()}</button>" + f"<p>{text(1, 2)}</p>" * int(rng.integers(2))
        elif kind == "comments":
            item = "li" if start.startswith(("<ol", "<ul")) else "div"
            inner = "".join(f"<{item}><p>{text(1, 4)}</p></{item}>" if rng.integers(2) else f"<{item}>{text(1, 3)}</{item}>" for _ in range(n))
        elif rng.integers(2):
            inner = text(1, 3)
        else:
            inner = "".join(f"<p>{text(1, 2)}</p>" if rng.integers(2) else f'<a href="#">{short()}</a> ' for _ in range(n))
        return start + inner + end

    def content() -> str:
        start, end = _opened(CONTENT[rng.integers(len(CONTENT))])
        out = [f"<h1>{mark}{short()}</h1>" if rng.integers(4) else f"<header><h1>{mark}{short()}</h1></header>"]
        for _ in range(rng.integers(1, 9)):
            kind = rng.integers(12)
            if kind == 0:
                out.append(f"<h2>{mark}{short()}</h2>")
            elif kind == 1:
                out.append("<ul>" + "".join(f"<li>{mark}{text(1, 2)}</li>" for _ in range(rng.integers(1, 5))) + "</ul>")
            elif kind == 2:
                out.append(f"<blockquote>{mark}{text(1, 3)}</blockquote>")
            elif kind == 3:
                out.append("<table>" + "".join(f"<tr><td>{mark}{short()}</td><td>{mark}{short()}</td></tr>" for _ in range(rng.integers(1, 4))) + "</table>")
            elif kind == 4:
                out.append(f"<div>{mark}{text(1, 4)}</div>")
            elif kind == 5:
                out.append(f"<pre>{mark}{text(1, 2)}</pre>")
            else:
                out.append(f"<p>{mark}{text(1, 8)}" + "</p>" * int(rng.integers(4) > 0))
            if not rng.integers(7):
                out.append(furniture(("advert", "notice", "side", "share", "form")[rng.integers(5)]))
        if not rng.integers(6):
            out.append(furniture("comments"))
        return start + "".join(out) + end

    before = [furniture(k) for k in ("header", "menu", "notice", "advert", "side", "form") if rng.integers(2)]
    after = [furniture(k) for k in ("share", "comments", "side", "menu", "advert", "form", "notice", "footer") if rng.integers(2)]
    page = f"<html><head><title>{short()}</title></head><body>" + "".join(before) + content() + "".join(after) + "</body></html>"
    found = leaves(page)
    labels = np.array([leaf.text.startswith(mark) for leaf in found], np.float32)
    for leaf in found:
        leaf.text = leaf.text.replace(mark, "").strip() or "x"
    return found, labels


def fit(pages: DataFrame, seed: int = 11) -> Labeller:
    """Trained on pages composed from the sentences of at most TRAIN_PAGES pages, which reach the driver."""
    sample = pages.select("page_id", whole_text("html").alias("html")).where("html <> ''").orderBy(F.xxhash64("page_id"), "page_id", "html").limit(TRAIN_PAGES)
    sentences = sorted({s.strip() for row in sample.toArrow().column("html").to_pylist() for leaf in leaves(row) for s in leaf.text.split(". ") if s.strip()}) or ["text"]
    rng = np.random.default_rng(seed)
    examples = [(vectors(p), y) for p, y in (composed(sentences, rng) for _ in range(COMPOSED))]
    return trained(examples, seed)


def main_texts(model: Labeller, pages: list[list[Leaf]]) -> list[str]:
    out = [""] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: -len(pages[i]))
    at = 0
    while at < len(order):
        group = order[at : at + max(1, min(256, 4096 // len(pages[order[at]])))]  # the first is the longest: a group has 4096 blocks, or one page
        at += len(group)
        logits, _ = model.forward(*_padded([vectors(pages[i]) for i in group]))
        for i, row in zip(group, logits, strict=True):
            out[i] = "\n".join(leaf.text for leaf, z in zip(pages[i], row, strict=False) if z > 0)
    return out


def extract(pages: DataFrame, model: Labeller) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    rows = pages.select("page_id", "url", whole_text("html").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = main_texts(shared.value, [leaves(h) for h in part.column(2).to_pylist()])
                columns = [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("page_id", "url")]
    return rows.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")


@query("op3_block_labeller")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
