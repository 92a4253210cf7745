"""Trains the block labeller's weights on generated pages whose labels are known by construction.

Run as ``python -m quarry.llm.html_training`` to write html_weights.npz anew (about two minutes).
Pages differ in containers, class names, order, nesting and damage (missing end tags); prose comes
from invented syllables, alike inside and outside the main text, so labels must come from structure,
boilerplate words and context.
"""

from __future__ import annotations

import sys

import numpy as np

from quarry.llm.html_blocks import leaf_blocks, vectors
from quarry.llm.html_extract import HIDDEN, WEIGHTS, BiLSTM, _sigmoid

_SYL = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve la que ch ein sch ung lich ent ver ier eau tre ción ado mente ñ ü é".split()
_MAIN_BOXES = [
    "article", "main", "section", 'div class="content"', 'div class="post-body"', 'div id="article-body"', 'div class="entry-content"',
    'div class="story"', 'article class="post"', 'div role="main"', 'div itemprop="articleBody" class="text"', 'section class="article"',
    'div id="main-content"', 'td class="body"', 'div class="blog-post"', "",
]
_SIDE = ["aside", 'div class="sidebar"', 'div id="sidebar"', 'aside class="widget"', 'div class="right-rail"', 'section class="related"', 'div class="recommended"', 'div class="most-read"']
_AD = ['div class="ad"', 'div class="ads"', 'div id="banner"', 'div class="advert"', 'div class="sponsored"', 'section class="promo"', 'div class="advertisement"']
_NOTICE = ['div class="cookie"', 'div id="cookie-banner"', 'div class="notice"', 'div class="consent"', 'div class="alert"', 'div role="alert"', 'section class="gdpr"', 'div class="newsletter"', 'div class="paywall"', 'div class="popup modal"']
_COMMENTS = ['section class="comments"', 'div id="comments"', 'ol class="commentlist"', 'div class="comment-list"', 'section id="discussion"', 'div class="replies"', 'ul class="reader-comments"', 'div class="disqus thread"']
_BOILER = {
    "nav": "home about contact login register news sports menu search archive help sitemap tags".split(),
    "footer": "copyright © all rights reserved privacy policy terms imprint contact powered by".split(),
    "notice": "we use cookies accept to improve your experience subscribe newsletter sign up close consent".split(),
    "comment": "reply says commented posted ago like report user thanks agree comment comments".split(),
    "ad": "advertisement sponsored buy now offer sale free discount shop".split(),
    "side": "related popular most read more share follow us latest trending recommended also".split(),
    "form": "email name password submit send search login".split(),
}


class Generator:
    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def one(self, items):
        return items[int(self.r.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def word(self) -> str:
        return "".join(self.one(_SYL) for _ in range(int(self.r.integers(1, 5))))

    def prose(self, least: int, most: int) -> str:
        n = int(self.r.integers(least, most + 1))
        words = [self.word() for _ in range(n)]
        style = self.r.random()
        if style < 0.08:
            return " | ".join(words)
        if style < 0.16:
            return " ".join(w + self.one(["###", "$$$", "!!", "%%%", "&amp;&amp;", "***"]) for w in words)
        out = []
        for i, w in enumerate(words):
            if i == 0 or out[-1].endswith("."):
                w = w.capitalize()
            out.append(w + (self.one([".", ",", "", "", "", "", "", ""])))
        return " ".join(out) + self.one([".", ".", ".", ""])

    def boiler(self, kind: str, least: int, most: int) -> str:
        return " ".join(self.one(_BOILER[kind]) if self.chance(0.6) else self.word() for _ in range(int(self.r.integers(least, most + 1))))

    def box(self, opening: str, inner: str) -> str:
        if not opening:
            return inner
        end = opening.split()[0]
        return f"<{opening}>{inner}</{end}>" if self.chance(0.96) else f"<{opening}>{inner}"

    # texts carry a mark, 1 for main and 0 for others, which is taken off again before training
    def mark(self, text: str, yes: int) -> str:
        return f"\ue001{text}" if yes else f"\ue000{text}"

    def paragraphs(self, n: int, yes: int, least: int = 1, most: int = 60) -> str:
        out = []
        for _ in range(n):
            t = self.prose(least, most)
            k = self.r.random()
            if k < 0.15:
                words = t.split()
                cut = int(self.r.integers(len(words) + 1))
                t = " ".join(words[:cut]) + self.one(["<b>", "<em>", '<a href="/x">', "<strong>", "<b>"]) + " ".join(words[cut:])
                t += self.one(["</b>", "</em>", "</a>", "</strong>", ""])
                out.append(f"<p>{self.mark(t, yes)}</p>")
            elif k < 0.25:
                out.append(f"<p>{self.mark(t, yes)}<br>" + self.mark(self.prose(least, most), yes) + self.one(["</p>", ""]))
            elif k < 0.31:
                out.append("<ul>" + "".join(f"<li>{self.mark(self.prose(1, 20), yes)}</li>" for _ in range(int(self.r.integers(1, 5)))) + "</ul>")
            elif k < 0.36:
                out.append(f"<{self.one(['h2', 'h3'])}>{self.mark(self.prose(1, 8), yes)}</h2>")
            elif k < 0.40:
                out.append(f"<blockquote><p>{self.mark(t, yes)}</p></blockquote>")
            elif k < 0.43:
                out.append(f"<pre>{self.mark(t, yes)}</pre>")
            elif k < 0.46:
                out.append("<table>" + "".join(f"<tr><td>{self.mark(self.prose(1, 4), yes)}</td><td>{self.mark(self.prose(1, 4), yes)}</td></tr>" for _ in range(int(self.r.integers(1, 4)))) + "</table>")
            elif k < 0.50:
                out.append(f"<div>{self.mark(t, yes)}</div>")
            else:
                out.append(f"<p>{self.mark(t, yes)}" + ("</p>" if self.chance(0.9) else ""))
        return "".join(out)

    def links(self, kind: str) -> str:
        n = int(self.r.integers(2, 9))
        words = [self.boiler(kind, 1, 3) if self.chance(0.5) else self.word() for _ in range(n)]
        if self.chance(0.7):
            return "<ul>" + "".join(f'<li><a href="/{i}">{self.mark(w, 0)}</a></li>' for i, w in enumerate(words)) + "</ul>"
        return " | ".join(f'<a href="/{i}">{self.mark(w, 0)}</a>' for i, w in enumerate(words))

    def prose_or(self, kind: str, most: int = 40) -> str:
        return self.prose(1, most) if self.chance(0.6) else self.boiler(kind, 1, 14)

    def comments(self) -> str:
        head = f"<h3>{self.mark(self.boiler('comment', 1, 3), 0)}</h3>" if self.chance(0.6) else ""
        each = ""
        for _ in range(int(self.r.integers(1, 6))):
            tag = self.one(["div", "li", 'div class="comment"', 'article class="comment"', 'li class="comment"', "p", 'div class="reply"'])
            who = f"<span>{self.mark(self.boiler('comment', 1, 3), 0)}</span>" if self.chance(0.5) else ""
            each += self.box(tag, who + (f"<p>{self.mark(self.prose_or('comment'), 0)}</p>" if self.chance(0.6) else self.mark(self.prose_or("comment"), 0)))
        return self.box(self.one(_COMMENTS), head + each)

    def advert(self) -> str:
        return self.box(self.one(_AD), self.mark(self.prose_or("ad"), 0) if self.chance(0.6) else f"<p>{self.mark(self.prose_or('ad'), 0)}</p>")

    def notice(self) -> str:
        return self.box(self.one(_NOTICE), f"<p>{self.mark(self.prose_or('notice'), 0)}</p>" + (f"<button>{self.mark('OK', 0)}</button>" if self.chance(0.4) else ""))

    def side(self) -> str:
        inner = f"<h3>{self.mark(self.boiler('side', 1, 3), 0)}</h3>" + (self.links("side") if self.chance(0.6) else self.paragraphs(int(self.r.integers(1, 3)), 0, 1, 30))
        return self.box(self.one(_SIDE), inner)

    def form(self) -> str:
        tag = self.one(["form", 'form class="search"', 'form id="subscribe"'])
        return self.box(tag, f"<label>{self.mark(self.boiler('form', 1, 4), 0)}</label><input name=q>" + (f"<p>{self.mark(self.prose_or('form', 20), 0)}</p>" if self.chance(0.3) else "") + f"<button>{self.mark(self.boiler('form', 1, 2), 0)}</button>")

    def footer(self) -> str:
        tag = self.one(["footer", "footer", 'div class="footer"', 'div id="footer"', 'footer class="site"'])
        inner = self.one([f"&copy; {self.word()}.example.net &middot; ", "", "&copy; 2024 "]) + self.prose_or("footer", 25)
        return self.box(tag, self.mark(inner, 0) + (self.links("footer") if self.chance(0.3) else ""))

    def page(self) -> str:
        title = self.prose(2, 12)
        main = f"<h1>{self.mark(title, 1)}</h1>" if self.chance(0.85) else ""
        if self.chance(0.2):
            main = self.box("header", main + (f'<p class="{self.one(["lead", "summary", "standfirst"])}">{self.mark(self.prose(5, 25), 1)}</p>' if self.chance(0.6) else ""))
        n = int(self.r.integers(1, 14))
        cut = int(self.r.integers(0, n + 1))
        main += self.paragraphs(cut, 1)
        inside = [self.advert, self.side, self.notice, self.form]
        if self.chance(0.25):
            main += self.one(inside)()
        main += self.paragraphs(n - cut, 1)
        if self.chance(0.12):
            main += self.comments()
        main = self.box(self.one(_MAIN_BOXES), main)
        if self.chance(0.25):
            main = self.box(self.one(['div class="wrapper"', 'div id="page"', "main", 'div class="container row"', "body"]), main)
        before, after = [], []
        if self.chance(0.85):
            tag = self.one(["nav", "nav", "nav", 'div class="menu"', 'ul class="nav"', 'div id="navigation"', 'header class="site"'])
            before.append(self.box(tag, self.links("nav")))
        if self.chance(0.4):
            before.append(self.box(self.one(["header", 'div class="header"', 'div id="masthead"', 'header class="top"']), (f"<h1>{self.mark(self.prose_or('nav', 5), 0)}</h1>" if self.chance(0.5) else f"<p>{self.mark(self.prose_or('nav', 12), 0)}</p>") + (self.links("nav") if self.chance(0.3) else "")))
        for kind, p in ((self.advert, 0.5), (self.notice, 0.3), (self.side, 0.3), (self.form, 0.2)):
            if self.chance(p):
                (before if self.chance(0.5) else after).append(kind())
        if self.chance(0.45):
            after.append(self.comments())
        self.r.shuffle(after)
        if self.chance(0.85):
            after.append(self.footer())
        body = "".join(before) + main + "".join(after)
        if self.chance(0.15):
            body = body.replace("</div>", "", 1)
        tail = "</body></html>" if self.chance(0.85) else ""
        return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}{tail}"


def examples(n: int, seed: int):
    """(vectors, labels) of generated pages; a block with marks of both kinds is left to the first."""
    g, out = Generator(seed), []
    while len(out) < n:
        blocks = leaf_blocks(g.page())
        labels = [float("\ue001" in b.text and (b.text.find("\ue001") < b.text.find("\ue000") or "\ue000" not in b.text)) for b in blocks]
        for b in blocks:
            b.text = b.text.replace("\ue000", "").replace("\ue001", "").strip() or "-"
        if blocks:
            out.append((vectors(blocks), np.array(labels, np.float32)))
    return out


def _padded(batch):
    steps = max(len(y) for _, y in batch)
    x = np.zeros((len(batch), steps, batch[0][0].shape[1]), np.float32)
    y = np.zeros((len(batch), steps), np.float32)
    m = np.zeros((len(batch), steps), np.float32)
    for k, (v, lab) in enumerate(batch):
        x[k, : len(lab)], y[k, : len(lab)], m[k, : len(lab)] = v, lab, 1
    return x, y, m


def gradients(model: BiLSTM, x, y, m):
    """Loss and gradients by back-propagation through time."""
    traces = {"f": [], "b": []}
    out = {d: model._run(x, m, d, traces[d]) for d in "fb"}
    both = np.concatenate([out["f"], out["b"]], axis=2)
    p = _sigmoid(both @ model.w["o"] + model.w["p"])
    total = m.sum()
    loss = -(m * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total
    dz = (p - y) * m / total
    grad = {"o": np.einsum("nt,ntk->k", dz, both), "p": np.array([dz.sum()], np.float32)}
    d_out = dz[:, :, None] * model.w["o"]
    for d, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, None))):
        dh_in = d_out[:, :, part]
        d_pre = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32)
        gh = np.zeros_like(model.w[f"h{d}"])
        dh, dc = np.zeros((len(x), HIDDEN), np.float32), np.zeros((len(x), HIDDEN), np.float32)
        for t, h, c, i, f, o, g, th, mk in reversed(traces[d]):
            dh = dh + dh_in[:, t]
            a, b = dh * mk, dc * mk + dh * mk * o * (1 - th * th)
            z = np.concatenate([b * g * i * (1 - i), b * c * f * (1 - f), a * th * o * (1 - o), b * i * (1 - g * g)], axis=1)
            d_pre[:, t] = z
            gh += h.T @ z
            dh, dc = dh * (1 - mk) + z @ model.w[f"h{d}"].T, dc * (1 - mk) + b * f
        grad[f"h{d}"] = gh
        grad[f"x{d}"] = np.einsum("ntk,ntj->kj", x, d_pre, optimize=True)
        grad[f"c{d}"] = d_pre.sum((0, 1))
    return loss, grad


def train(pages: int = 10_000, rounds: int = 9, seed: int = 3, size: int = 48) -> BiLSTM:
    model, data, rng = BiLSTM.fresh(), examples(pages, seed), np.random.default_rng(seed)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step, steps = 0, rounds * (len(data) // size)
    for _ in range(rounds):
        order = rng.permutation(len(data))
        for a in range(0, len(data) - size + 1, size):
            loss, grad = gradients(model, *_padded([data[i] for i in order[a : a + size]]))
            step += 1
            rate = 0.01 * (1 - step / (steps + 1)) + 1e-4
            norm = np.sqrt(sum((g**2).sum() for g in grad.values()))
            for k, g in grad.items():
                g = g * min(1, 5 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                model.w[k] = (model.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"loss {loss:.4f}", file=sys.stderr)
    return model


def accuracy(model: BiLSTM, data) -> tuple[float, float]:
    """Shares of blocks and of whole pages labelled right."""
    got = model.label([v for v, _ in data])
    blocks = np.concatenate([g == (y > 0.5) for g, (_, y) in zip(got, data)])
    return float(blocks.mean()), float(np.mean([(g == (y > 0.5)).all() for g, (_, y) in zip(got, data)]))


if __name__ == "__main__":
    trained = train()
    print("blocks and pages right on unseen generated pages:", accuracy(trained, examples(1000, 99)))
    np.savez_compressed(WEIGHTS, **{k: v.astype(np.float16) for k, v in trained.w.items()})
