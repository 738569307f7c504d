"""HTML extraction: a linear-chain conditional random field over a page's leaf blocks.

A block's features are its ancestors' tags, the words of their class, id and role, and
the shape of its text.  Labels are main text or not.  The field is trained on labelled
pages and decoded by Viterbi.

The provided tables hold no labels for pages, so the labelled pages are built here: page
layouts with known main text (``labelled_pages``), and a bounded sample of the table's
own pages that mark their main text with one <article> or <main> (``marked_pages``).
"""

from __future__ import annotations

import random
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import about
from .html_blocks import SIDE_NAMES, SIDE_PARTS, Block, Place, blocks

#: Built layouts and sampled pages that the fit uses at most.
BUILT, SAMPLED = 500, 200


def path_features(place: Place) -> list[str]:
    out = ["bias", *sorted(f"in={t}" for t in place.tags)]  # sorted: sums must not depend on the process
    out.append(f"own={place.own}")
    out += [f"name={w}" for w in sorted(place.names)]
    out += ["side name"] * any(w in SIDE_NAMES or w in SIDE_PARTS for w in place.names)
    out.append(f"inner={place.inner}")
    return out


def text_features(block: Block, i: int, n: int) -> tuple[str, ...]:
    size, text = len(block.text), block.text
    links = 0 if not block.linked else 1 if 2 * block.linked < size else 2
    length = 0 if size < 15 else 1 if size < 40 else 2 if size < 120 else 3
    return (f"length={length}", f"links={links}", f"end={text[-1] in '.!?…:;”\"'}", f"sign={text[0] in '©®|»›'}", f"first={i == 0}", f"last={i == n - 1}", f"alone={n == 1}")


@dataclass
class Field:
    """Weights of features by label, and of transitions; scores are kept by distinct path and text shape."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray  # (2, 2): from, to
    _paths: dict = field(default_factory=dict, repr=False)
    _texts: dict = field(default_factory=dict, repr=False)

    def _sum(self, names) -> tuple[float, float]:
        out = np.zeros(2)
        for f in names:
            if f in self.weights:
                out += self.weights[f]
        return float(out[0]), float(out[1])

    def labels(self, page: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not page:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        back, v0, v1 = [], 0.0, 0.0
        for i, b in enumerate(page):
            if (p := self._paths.get(b.place)) is None:
                if len(self._paths) > 50_000:
                    self._paths.clear()
                p = self._paths[b.place] = self._sum(path_features(b.place))
            shape = text_features(b, i, len(page))
            if (t := self._texts.get(shape)) is None:
                t = self._texts[shape] = self._sum(shape)
            e0, e1 = p[0] + t[0], p[1] + t[1]
            if i == 0:
                v0, v1 = e0, e1
                continue
            f0, f1 = v1 + m10 > v0 + m00, v1 + m11 > v0 + m01
            back.append((f0, f1))
            v0, v1 = (v1 + m10 if f0 else v0 + m00) + e0, (v1 + m11 if f1 else v0 + m01) + e1
        out = [int(v1 > v0)]
        for f in reversed(back):
            out.append(int(f[out[-1]]))
        return out[::-1]

    def main_text(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n".join(b.text for b, y in zip(found, self.labels(found)) if y)


def fit(pages: list[tuple[list[Block], list[int]]], rounds: int = 120, rate: float = 0.8, l2: float = 1e-3) -> Field:
    """Maximise the conditional log-likelihood by gradient ascent (Adagrad), with forward-backward sums."""
    names: dict[str, int] = {}
    data = []
    for page, labels in pages:
        if page:
            rows = [[names.setdefault(f, len(names)) for f in (*path_features(b.place), *text_features(b, i, len(page)))] for i, b in enumerate(page)]
            data.append((rows, np.array(labels)))
    w, moves = np.zeros((len(names), 2)), np.zeros((2, 2))
    flat = np.array([f for rows, _ in data for r in rows for f in r], np.int64)
    owner = np.repeat(np.arange(sum(len(r) for r, _ in data)), [len(r) for rows, _ in data for r in rows])
    gold = np.concatenate([y for _, y in data]) if data else np.zeros(0, np.int64)
    # pages side by side, so that one step of the chain runs over all of them
    lengths = np.array([len(r) for r, _ in data])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if data else np.zeros(0, np.int64)
    seen_w, seen_m = np.full(w.shape, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds if data else 0):
        e = np.stack([np.bincount(owner, w[flat, c], len(gold)) for c in (0, 1)], 1)
        a = np.zeros_like(e)
        b = np.zeros_like(e)
        longest = int(lengths.max())
        for i in range(longest):
            on = starts[lengths > i] + i
            a[on] = e[on] if i == 0 else e[on] + np.logaddexp(a[on - 1, 0][:, None] + moves[0], a[on - 1, 1][:, None] + moves[1])
        for i in range(longest - 2, -1, -1):
            on = starts[lengths > i + 1] + i
            nxt = e[on + 1] + b[on + 1]
            b[on] = np.logaddexp(moves[:, 0] + nxt[:, :1], moves[:, 1] + nxt[:, 1:])
        z = np.logaddexp(*(a[starts + lengths - 1]).T)
        zz = np.repeat(z, lengths)
        p = np.exp(a + b - zz[:, None])
        g = -p
        g[np.arange(len(gold)), gold] += 1
        grad = np.stack([np.bincount(flat, g[owner, c], len(names)) for c in (0, 1)], 1) / len(data) - l2 * w
        step = np.ones(len(gold), bool)
        step[starts] = False
        to = np.flatnonzero(step)
        pair = a[to - 1][:, :, None] + moves + (e[to] + b[to])[:, None, :] - zz[to][:, None, None]
        gm = -np.exp(pair).sum(0)
        np.add.at(gm, (gold[to - 1], gold[to]), 1)
        gm = gm / len(data) - l2 * moves
        seen_w += grad**2
        seen_m += gm**2
        w += rate * grad / np.sqrt(seen_w)
        moves += rate * gm / np.sqrt(seen_m)
    return Field({f: w[i] for f, i in names.items()}, moves)


def labelled_pages(n: int = BUILT, seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Built pages: main text in known places, around it what pages have beside it.

    Main blocks are marked by a word that is taken off again before features are made.
    """
    draw = random.Random(seed)
    words = "lorem ipsum dolor sit amet consectetur elit sed eiusmod tempor magna aliqua enim minim veniam quis nostrud".split()

    def say(a: int, b: int, end: str = ".") -> str:
        return " ".join(draw.choice(words) for _ in range(draw.randint(a, b))).capitalize() + end

    def links(k: int) -> str:
        return "".join(f'<li><a href="/x">{say(1, 3, "")}</a></li>' for _ in range(k))

    def box(names: str, inner: str, tags: str = "div section aside ul") -> str:
        tag, attr = draw.choice(tags.split()), draw.choice(["class", "id", "class"])
        return f'<{tag} {attr}="{draw.choice(names.split())}">{inner}</{tag}>'

    def main(k: int) -> str:
        kinds = [lambda: f"<p>@@ {say(8, 60)}</p>", lambda: f"<p>@@ <b>{say(2, 8)}</b> {say(5, 30)}", lambda: f"<h2>@@ {say(2, 6, '')}</h2>", lambda: f"<ul><li>@@ {say(3, 12)}</li><li>@@ {say(3, 12, '')}</li></ul>", lambda: f"<blockquote>@@ {say(6, 20)}</blockquote>", lambda: f"<p>@@ {say(1, 4)}</p>", lambda: f'<p>@@ {say(4, 12)} <a href="/y">{say(2, 4, "")}</a> {say(3, 9)}</p>', lambda: f"<pre>@@ {say(3, 15)}</pre>", lambda: f"<table><tr><td>@@ {say(1, 3, '')}</td><td>@@ {say(1, 3, '')}</td></tr></table><p>@@ {say(2, 20)}</p>"]
        weights = [8, 2, 1, 1, 1, 2, 1, 0.3, 0.8]
        return f"<h1>@@ {say(3, 9, draw.choice(['', '.']))}</h1>" + "".join(draw.choices(kinds, weights)[0]() for _ in range(k))

    def comments() -> str:
        """Reader comments, most of them in paragraphs or items like those of the main text."""
        each = draw.choice([lambda: f'<div class="comment"><b>{say(1, 2, "")}</b><p>{say(4, 40)}</p></div>', lambda: f"<p>{say(4, 40)}</p>", lambda: f"<li>{say(4, 40)}</li>", lambda: f"<h4>{say(1, 2, '')}</h4><p>{say(4, 40)}</p>"])
        return box("comments comment-list commentlist respond replies disqus_thread feedback reader-feedback discussion responses guestbook talkback", "".join(each() for _ in range(draw.randint(1, 4))), "div section ol")

    def side() -> str:
        return draw.choice([
            lambda: box("ad ads advert advertisement banner sponsored promo", say(3, 20)),
            lambda: box("sidebar widget related", f"<h3>{say(1, 3, '')}</h3><ul>{links(4)}</ul><p>{say(5, 20)}</p>"),
            lambda: f"<aside><h3>{say(1, 4, '')}</h3><p>{say(5, 25)}</p></aside>",
            lambda: box("cookie-notice consent notice disclaimer popup", f"<p>{say(6, 25)}</p><button>{say(1, 2, '')}</button>"),
            lambda: box("share social tags newsletter subscribe breadcrumb pagination", f"<span>{say(1, 6, '')}</span><p>{say(3, 10)}</p>"),
            lambda: f"<form><label>{say(1, 3, '')}</label><input><button>{say(1, 2, '')}</button><p>{say(2, 8)}</p></form>",
            comments, comments,
            lambda: f"<nav><ul>{links(draw.randint(2, 6))}</ul></nav>",
        ])()

    out = []
    for _ in range(n):
        body = main(draw.randint(1, 9))
        if draw.random() < 0.4:
            body += side()
        elif draw.random() < 0.5:
            at = body.find("<p>", len(body) // 2)
            body = body[:at] + side() + body[at:] if at > 0 else body
        open_, close = draw.choice([("<article>", "</article>")] * 4 + [("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="main"><div class="post">', "</div></div>"), ('<main><article class="entry">', "</article></main>"), ("", "")])
        head = draw.choice([f"<nav><ul>{links(draw.randint(2, 8))}</ul></nav>", f"<header><p>{say(1, 6, '')}</p><nav><ul>{links(5)}</ul></nav></header>", box("header masthead menu navbar", f"<ul>{links(4)}</ul><p>{say(2, 8)}</p>"), ""])
        foot = draw.choice([f"<footer>&copy; {say(1, 4)} &middot; {say(2, 12)}</footer>", f"<footer><p>{say(3, 20)}</p><ul>{links(3)}</ul></footer>", box("footer copyright", f"<p>© {say(2, 15)}</p>"), ""])
        page = head + "".join(side() for _ in range(draw.randint(0, 2))) + open_ + body + close + "".join(side() for _ in range(draw.randint(0, 2))) + foot
        if draw.random() < 0.12:  # nothing but main text, with few tags or none
            page = draw.choice([f"@@ {say(2, 40)}", f"<p>@@ {say(1, 40)}</p>", body, f"<html><body>{main(draw.randint(1, 4))}</body></html>"])
        found = blocks(page)
        out.append(([Block(b.place, b.text.replace("@@ ", ""), b.linked) for b in found], [int("@@" in b.text) for b in found]))
    return out


def marked_pages(pages: list[str]) -> list[tuple[list[Block], list[int]]]:
    """Pages with one <article> or <main>, labelled by it: inside it and in no side element is main text."""
    out = []
    for page in pages:
        if page.lower().count("<article") + page.lower().count("<main") == 1:
            found = blocks(page)
            out.append((found, [int("inner=1" in path_features(b.place) and not b.place.tags.isdisjoint(("article", "main"))) for b in found]))
    return out


def train(pages: DataFrame | None = None, built: int = BUILT, sampled: int = SAMPLED, id_col: str = "page_id", html_col: str = "html") -> Field:
    """Fit on ``built`` layouts and ``sampled`` pages of the table at most, those with the smallest hash of id."""
    own = []
    if pages is not None and sampled:
        keyed = pages.where(F.col(html_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("i"), F.col(html_col).alias("h"))
        ids = keyed.select("i").where(about(sampled, keyed.count(), F.col("i"))).orderBy(F.xxhash64("i"), "i").limit(sampled)
        rows = keyed.join(F.broadcast(ids.distinct()), "i").collect()  # about ``sampled`` pages
        own = marked_pages([r["h"] for r in sorted(rows, key=lambda r: (str(r["i"]), r["h"]))])
    return fit(labelled_pages(built) + own)


def extract_main_text(pages: DataFrame, model: Field, html_col: str = "html", keep: tuple[str, ...] | None = None) -> DataFrame:
    """Add text and n_chars: the blocks labelled as main text, joined by line feeds.

    Null and empty pages, and pages without main text, give an empty text.  Each row is
    extracted by itself, so repeated rows come out alike; pages may be of any length, depth
    and number of attributes; equally likely labels fall to the side of no main text.  An
    empty table gives an empty result.  Input columns
    named text or n_chars give way; ``keep`` limits the input columns that come back.
    """
    import pyarrow as pa

    keep = [c for c in (keep or pages.columns) if c not in ("text", "n_chars")]
    slim = pages.select(*keep, F.col(html_col).alias("__html"))
    shared = pages.sparkSession.sparkContext.broadcast(model)  # a few hundred weights

    def run(batches):
        for batch in batches:
            texts = [shared.value.main_text(h.as_py()) for h in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    fields = ", ".join(f"`{c}` {t}" for c, t in pages.select(*keep).dtypes)
    return slim.mapInArrow(run, f"{fields}, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages, train(pages), keep=("page_id", "url"))
