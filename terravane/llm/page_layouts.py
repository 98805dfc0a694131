"""Labelled pages to train on: layouts with a mark for what is main text, filled with given sentences."""

from __future__ import annotations

import random

# Layouts of pages.  {m} is a paragraph of the article, {h} a heading of it, {s} a short phrase, {l} a link, {t} a
# longer text that is not part of the article.
LAYOUTS = (
    '<html><head><title>{s}</title><style>p{margin:0}</style></head><body><nav><ul>{l}{l}{l}{l}</ul></nav><div class="ad">{t}</div><article><h1>{h}</h1><p><b>{m}<br><p>{m}</p><p>{m}</p></article><footer>&copy; {s} &middot; {t}</footer></body></html>',
    '<body><header><a href="/">{s}</a><p>{s}</p></header><main><h1>{h}</h1><p>{m}</p><h2>{h}</h2><p>{m}</p><ul><li>{m}</li><li>{m}</li></ul></main><aside><h3>{s}</h3><ul>{l}{l}{l}</ul></aside><footer><p>{t}</p></footer></body>',
    '<body><div id="header"><ul class="menu">{l}{l}{l}</ul></div><div id="content"><h1>{h}</h1><p>{m}</p><p>{m}</p><p>{m}</p></div><div id="sidebar"><p>{t}</p>{l}{l}</div><div id="footer">{s}</div></body>',
    '<body><div class="cookie-notice"><p>{t}</p><button>{s}</button></div><div class="nav">{l}{l}{l}</div><div class="post"><h2>{h}</h2><div class="entry-content"><p>{m}</p><blockquote>{m}</blockquote><p>{m}</p></div></div><div id="comments"><h3>{s}</h3><div class="comment"><p>{t}</p></div><div class="comment"><p>{t}</p></div></div><div class="footer">{s}</div></body>',
    '<body><article><header><h1>{h}</h1></header><p>{m}</p><aside class="related"><p>{t}</p>{l}</aside><p>{m}</p><div class="advert">{t}</div><p>{m}</p><section class="comments"><h2>{s}</h2><p>{t}</p><p>{t}</p></section></article><footer>{s}</footer></body>',
    '<body><nav>{l}{l}{l}{l}{l}</nav><section class="article-body"><h1>{h}</h1><p>{m}</p><p>{m}</p></section><form action="/s"><label>{s}</label><input><p>{t}</p></form><div class="newsletter"><p>{t}</p></div><footer>{l}{l}<p>{s}</p></footer></body>',
    '<body><div class="banner notice">{t}</div><div class="wrapper"><div class="main"><h1>{h}</h1><p>{m}</p><p>{m}</p><table><tr><td>{m}</td><td>{m}</td></tr></table></div><div class="side widget"><h4>{s}</h4><p>{t}</p></div></div><div class="copyright">&copy; {s}</div></body>',
    '<body><div role="navigation">{l}{l}</div><div role="main"><h1>{h}</h1><p>{m}</p><p>{m}</p></div><div class="promo sponsored"><p>{t}</p></div><div role="contentinfo">{s}</div></body>',
    '<body><p>{m}</p><p>{m}</p><p>{m}</p></body>',
    '<body><h1>{h}</h1><p>{m}</p><p>{m}</p><hr><p>{m}</p></body>',
    '<body><div><div><p>{m}</p><p>{m}</p></div></div><div class="breadcrumb">{l}{l}</div><div class="share social">{l}{l}{l}</div><ol class="comment-list"><li>{t}</li><li>{t}</li></ol></body>',
    '<body><header class="site-header"><h1>{s}</h1><nav>{l}{l}</nav></header><article class="post"><h2>{h}</h2><p>{m}</p><figure><img><figcaption>{m}</figcaption></figure><p>{m}</p></article><div class="popup modal">{t}</div><div class="ads">{t}</div><noscript>{t}</noscript></body>',
    '<body><div class="topbar">{l}{l}</div><td class="content"><font>{m}<br>{m}</font></td><div class="ad">{t}</div><div class="subscribe"><form><p>{t}</p></form></div><div class="disclaimer">{t}</div></body>',
    '<body><main><article><h1>{h}</h1><p>{m}</p><pre>{m}</pre><p>{m}</p><nav class="pagination">{l}{l}</nav></article><div class="reader-comments discussion"><article><p>{t}</p></article><article><p>{t}</p></article></div></main><aside>{t}</aside></body>',
    '<body><div class="alert-box notice">{t}</div><aside class="sidebar"><p>{t}</p><p>{t}</p></aside><div class="story"><h1>{h}</h1><p>{m}</p><p>{m}</p></div><div class="recommended more-links">{l}{l}{l}</div><address>{s}</address></body>',
)
MAIN = "⁣"  # set before what is main text, never written by a page

DEFAULT_SENTENCES = (
    "Heavy rain is expected in the hill districts until Tuesday evening, and rivers may rise fast.",
    "The shutters of the dam were raised by thirty centimetres this morning.",
    "Slopes above the road have moved again, so traffic is led through the valley.",
    "Residents of low places are asked to move to the camps before night.",
)


def labelled_pages(sentences: list[str], copies: int = 12, seed: int = 11) -> list[str]:
    """Pages of every layout; each run of main text begins with :data:`MAIN`."""
    rng = random.Random(seed)
    pool = [s for s in sentences if s.strip()] or list(DEFAULT_SENTENCES)

    def some(n: int) -> str:
        words = " ".join(rng.choice(pool) for _ in range(2)).split()
        at = rng.randrange(max(1, len(words) - n))
        return " ".join(words[at : at + n]).replace("<", "").replace("&", "&amp;")

    def page(layout: str) -> str:
        out, i = [], 0
        while i < len(layout):
            if layout[i] == "{" and layout[i + 2 : i + 3] == "}":
                kind = layout[i + 1]
                if kind == "m":
                    out.append(MAIN + some(rng.choice((3, 8, 20, 40, 80))))
                elif kind == "h":
                    out.append(MAIN + some(rng.randint(2, 12)))
                elif kind == "s":
                    out.append(some(rng.randint(1, 5)))
                elif kind == "l":
                    out.append(f'<li><a href="/x">{some(rng.randint(1, 4))}</a></li>')
                else:
                    out.append(some(rng.choice((3, 8, 20, 50))))
                i += 3
            else:
                out.append(layout[i])
                i += 1
        return "".join(out)

    return [page(layout) for _ in range(copies) for layout in LAYOUTS]
