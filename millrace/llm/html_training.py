"""Labelled pages from which the extraction model is trained: made up here, of many layouts, from a seed.

A node's label is the ``data-content`` attribute of its nearest ancestor that has one; the parser takes
the attribute out, so that the model never sees it.
"""

from __future__ import annotations

import random

_SYLLABLES = "ka lo mi ten ra vo se du ni pra sto el um ast ori ge wen fi za bru cha hel ing er ou".split()


def labelled_pages(n: int = 400, seed: int = 11) -> list[str]:
    """``n`` pages of varied layout with ``data-content="1"`` on content and ``"0"`` on what surrounds it."""
    r = random.Random(seed)

    def word() -> str:
        return "".join(r.choices(_SYLLABLES, k=r.choice([1, 1, 2, 2, 3])))

    def words(a: int, b: int) -> str:
        return " ".join(word() for _ in range(r.randint(a, b)))

    def sentence() -> str:
        s = [word() for _ in range(r.randint(2, 22))]
        if len(s) > 6 and r.random() < 0.6:
            s[r.randrange(2, len(s) - 2)] += ","
        if r.random() < 0.1:
            k = r.randrange(len(s))
            s[k] = f'<a href="/{word()}">{s[k]}</a>'
        if r.random() < 0.1:
            k = r.randrange(len(s))
            s[k] = f"<{(t := r.choice(['b', 'i', 'em', 'strong', 'span']))}>{s[k]}</{t}>"
        mark = r.choice([".", ".", ".", ".", "!", "?", "", "&amp;", "***"])
        return " ".join(s).capitalize() + mark

    def paragraph() -> str:
        return " ".join(sentence() for _ in range(r.choice([1, 1, 1, 2, 3, 5, 8])))

    def links(k: int) -> list[str]:
        return [f'<a href="/{word()}">{words(1, 3)}</a>' for _ in range(k)]

    def menu() -> str:
        kind = r.choice(["nav", "div", "ul", "header", "aside"])
        name = r.choice(["", ' class="menu"', ' id="nav"', ' class="sidebar"', ' class="links"', ' class="breadcrumb"'])
        items = links(r.randint(2, 12))
        if kind == "ul":
            return f'<ul data-content="0"{name}>' + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
        body = "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>" if r.random() < 0.6 else " | ".join(items)
        return f'<{kind} data-content="0"{name}>{body}</{kind}>'

    def ad() -> str:
        name = r.choice(["ad", "ads", "banner", "promo", "sponsor", "cookie", "share", "related", "comments"])
        text = paragraph() if r.random() < 0.7 else words(2, 6)
        return f'<{(t := r.choice(["div", "div", "aside", "section"]))} data-content="0" {r.choice(["class", "id"])}="{name}">{text}</{t}>'

    def footer() -> str:
        t = r.choice(["footer", "div", "footer"])
        name = "" if t == "footer" else ' class="footer"'
        return f'<{t} data-content="0"{name}>{r.choice([paragraph(), words(3, 8), " ".join(links(4)), "&copy; " + words(2, 5)])}</{t}>'

    def content() -> str:
        t, name = r.choice([("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' id="main"'), ("div", ' class="entry"'), ("section", ' class="story"'), ("div", "")])
        out = [f"<h1>{r.choice([sentence(), words(1, 7)])}</h1>"] if r.random() < 0.8 else []
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            k = r.random()
            if k < 0.66:
                out.append(f"<p>{paragraph()}" + r.choice(["</p>", "</p>", "</p>", ""]))
            elif k < 0.74:
                out.append(f"<p><b>{r.choice([paragraph(), sentence()])}<br>")
            elif k < 0.8:
                out.append(f"<h2>{words(1, 6)}</h2>")
            elif k < 0.85:
                out.append("<ul>" + "".join(f"<li>{sentence()}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote>{paragraph()}</blockquote>")
            elif k < 0.91:
                out.append(f"<pre><code>{words(4, 30)}</code></pre>")
            elif k < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(r.randint(2, 5))) + "</table>")
            elif k < 0.97:
                out.append(ad())
            else:
                out.append(f"<div>{paragraph()}<br>{paragraph()}</div>")
        body = "\n".join(out) if r.random() < 0.5 else "".join(out)
        return f'<{t} data-content="1"{name}>{body}</{t}>'

    pages = []
    for _ in range(n):
        before = [f() for f in r.choices([menu, menu, ad], k=r.randint(0, 3))]
        after = [f() for f in r.choices([menu, ad, footer, footer], k=r.randint(0, 3))]
        body = before + [content()] + after
        if r.random() < 0.4:
            body = [f'<div class="{word()}">', *body, "</div>"]
        script = "<script>var a='<p>x</p>';</script>" if r.random() < 0.5 else ""
        pages.append(f'<!DOCTYPE html><html data-content="0"><head><title>{words(1, 5)}</title>{script}<style>p{{}}</style></head><body>{"".join(body)}</body></html>')
    return pages
