"""Pages by hand: html, the main text's blocks, and what must not be in it."""

S = "alpha beta gamma delta omega, some longer words of plain prose that go on."
X = "The committee met on Tuesday to discuss the new bridge over the river, which has been closed since the spring floods."
Y = "Residents asked for a date. None was given, though the engineers said that repairs would take at least until autumn."
Z = "Gulls circled over the empty market while the vendors packed their last crates of apples and walked home."
CN = "市政府星期二召开会议，讨论河上新桥的建设问题。这座桥自春季洪水以来一直关闭，居民们希望尽快知道开放的日期。"
MENU = "<ul><li><a href=/>Home page</a></li><li><a href=/n>News items</a></li><li><a href=/c>Contact us</a></li></ul>"
NOISE = ("Home page", "News items", "Contact us", "All rights reserved", "cookies on this site", "Related reading", "First reader says", "Subscribe now")
FOOT = "<footer class=site-footer>© All rights reserved 2024</footer>"
COOKIE = "<div class='cookie-notice'><p>We use cookies on this site to count visits.</p><button>OK</button></div>"
SIDE = "<aside class=sidebar><h3>Related reading</h3><ul><li><a href=/1>Bridges of old</a></li><li><a href=/2>Floods of spring</a></li></ul></aside>"
COMMENTS = "<section class=comments><h3>Comments</h3><div class=comment><b>Ann</b><p>First reader says it is about time that somebody did it.</p></div></section>"
FORM = "<form class=newsletter><label>Subscribe now</label><input name=mail><button>Send</button></form>"


def p(*parts):
    return "".join(f"<p>{x}</p>" for x in parts)


def page(body, attrs=""):
    return f"<!DOCTYPE html><html><head><title>t</title></head><body{attrs}>{body}</body></html>"


WORDS39 = " ".join(["word"] * 39)
PAGES = {
    "blog theme, two paragraphs": (page(f"<div id=page class=site><header class=site-header>{MENU}</header><main id=main class=site-main><article class='post hentry'><h1 class=entry-title>A title</h1><div class=entry-content>{p(X, Y)}</div></article></main>{SIDE}{FOOT}</div>", " class='has-sidebar single'"), ["A title", X, Y]),
    "blog theme, many paragraphs": (page(f"<div id=page class=site><main class=site-main><article class=post><div class=entry-content>{p(*[X, Y] * 10)}</div></article></main>{SIDE}</div>", " class=has-sidebar"), [X, Y] * 10),
    "blog theme without article": (page(f"<div id=page class=site>{MENU}<div class=entry-content>{p(X, Y)}</div>{SIDE}{FOOT}</div>", " class=has-sidebar"), [X, Y]),
    "one wrapper named site": (f"<div class=site><h1>A title</h1>{p(X, Y)}</div>", ["A title", X, Y]),
    "body with-sidebar": (page(f"<h1>A title</h1>{p(X, Y)}", " class=with-sidebar"), ["A title", X, Y]),
    "has-sidebar round an article": (page(f"<article>{p(X, Y)}</article>", " class=has-sidebar"), [X, Y]),
    "has-sidebar round ten paragraphs": (page(f"<article>{p(*[X, Y] * 5)}</article>", " class=has-sidebar"), [X, Y] * 5),
    "div contact": (f"<div id=contact>{p(X, Y)}</div>", [X, Y]),
    "one form round all": (page(f"<form id=aspnetForm method=post><div class=nav>{MENU}</div><div id=main>{p(X, Y, Z)}</div>{FOOT}</form>"), [X, Y, Z]),
    "39 words": (page(p(WORDS39)), [WORDS39]),
    "41 words": (page(p(WORDS39 + " more words")), [WORDS39 + " more words"]),
    "a few words": (page(p("Five words and no more.")), ["Five words and no more."]),
    "Chinese": (page(f"<article>{p(CN * 2, CN)}</article>"), [CN * 2, CN]),
    "Chinese, no article": (page(f"<div class=nav>{MENU}</div><div class=content>{p(CN, CN)}</div>{FOOT}"), [CN, CN]),
    "svg within a paragraph": (f"<article><p>a <svg/> b {' '.join(['word'] * 29)}</p></article>", ["a b " + " ".join(["word"] * 29)]),
    "svg with a path": (page(f"<article>{p(X + ' <svg><path d=1></path></svg> ' + Y)}</article>"), [X + " " + Y]),
    "cookie notice first": (page(f"{COOKIE}<main><h1>A title</h1>{p(X, Y)}</main>{FOOT}"), ["A title", X, Y]),
    "comments after": (page(f"<nav>{MENU}</nav><article><h2>A title</h2>{p(X, Y)}</article>{COMMENTS}{FOOT}"), ["A title", X, Y]),
    "comments inside": (page(f"<article><h2>A title</h2>{p(X, Y)}{COMMENTS}</article>{FOOT}"), ["A title", X, Y]),
    "form inside": (page(f"<article>{p(X)}{FORM}{p(Y)}</article>{FOOT}"), [X, Y]),
    "layout table": (page(f"<table><tr><td width=120>{MENU}</td><td><h2>A title</h2>{p(X, Y)}</td></tr></table>"), ["A title", X, Y]),
    "text with line breaks": (page(f"{X}<br><br>{Y}<br><br>{Z}"), [X + " " + Y + " " + Z]),
    "nested nameless": (page(f"<div><div><div><div>{p(X, Y, Z)}</div></div></div></div>"), [X, Y, Z]),
    "list in the article": (page(f"<article>{p(X)}<ul><li>first thing to do</li><li>second thing to do</li></ul>{p(Y)}</article>{SIDE}"), [X, "first thing to do", "second thing to do", Y]),
    "quote and figure": (page(f"<main><article>{p(X)}<blockquote><p>{Z}</p></blockquote><figure><img src=a><figcaption>A gull on a post</figcaption></figure>{p(Y)}</article></main>"), [X, Z, "A gull on a post", Y]),
    "links in the text": (page(f"<article>{p(X + ' See <a href=/x>the plan</a> for more.', Y)}</article><nav>{MENU}</nav>"), [X + " See the plan for more.", Y]),
    "section with an id": (page(f"<header><a href=/>Home page</a></header><section id=story>{p(X, Y)}</section>{FOOT}"), [X, Y]),
    "unknown names": (page(f"<div class=zq-header>{MENU}</div><div class=xk91><div class=mm-body-3>{p(X, Y, Z)}</div></div>{FOOT}"), [X, Y, Z]),
    "article header": (page(f"<article><header><h1>A title</h1></header>{p(X, Y)}</article>"), ["A title", X, Y]),
    "references": (page(f"<article>{p('Salt &amp; pepper &lt;here&gt; &eacute;t&eacute;, ' + X)}</article>"), ["Salt & pepper <here> été, " + X]),
    "menu and footer only": (page(f"<nav>{MENU}</nav>{FOOT}"), []),
    "all wrappers": (page(f"<div class=outer><div class='layout right-sidebar'><div class=wrapper><div class=content>{p(X, Y)}</div>{SIDE}</div></div></div>{FOOT}", " class='home sticky-header'"), [X, Y]),
}
